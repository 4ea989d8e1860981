"""WARC archives of pages, found again through a two-level capture index.

Archives are gzip members one after another. The index is a run of shard files: lines
``key file offset length`` sorted by reversed-host key, in compressed blocks, with the
first key of each block in a sparse directory at the end of its shard. A look-up
searches the list of shards, then a shard's directory, reads the blocks in question, and
searches their lines; only then are ranges of the archives read.

Files are written below the shared folder by name of the attempt that wrote them, and
only names that a finished task returned are ever read, so a task that is run again
does no harm. The folder is any address that ``pyarrow.fs`` reaches from the executors.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

LEAST_BYTES = 1000          # of a payload, for equal ones to be kept once
DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 1 << 30     # a file is closed beyond this
SHARD_BYTES = 1 << 28       # of index lines, about, in a shard
BLOCK_BYTES, BLOCK_LINES = 1 << 18, 3000
TASK_BYTES = 32 << 20       # of archives or blocks read by a task
SALTS = 16
_TRAILER = "<QQ8s"
_MARK = b"captures"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LOCATORS = "key string, file string, offset long, length long"


@dataclass(frozen=True)
class Store:
    """Archives and index below ``folder``; ``shards`` is one small row per shard."""

    folder: str
    shards: list
    archive_bytes: int
    page_type: str


def url_key(url: Column) -> Column:
    """``http://www.Example.org:80/a?b#c`` as ``org,example,www)/a?b``.

    Scheme, user, port and fragment do not count; a null address has an empty host.
    White space and control characters are ``%20``.
    """
    start = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, start + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, start + "[^/?#]*", ""), "(?s)#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"),
                   F.when(path == "", "/").otherwise(path))
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _named(fields: dict) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()


def _record(kind: str, fields: dict, block: bytes) -> bytes:
    """One gzip member; the same input gives the same bytes."""
    head = _named({"WARC-Type": kind, "WARC-Date": DATE, **fields, "Content-Length": len(block)})
    return gzip.compress(b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _page_record(r: dict) -> bytes:
    payload = r["payload"]
    http = b"HTTP/1.1 200 OK\r\n" + _named({
        "Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)}) + b"\r\n"
    again = r["leader"] is not None and r["leader"] != r["rid"]
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", r["url"] or "")
    return _record("revisit" if again else "response", {
        "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(int=r['rid'])}>",
        "WARC-Target-URI": target or None, "WARC-Payload-Digest": f"sha1:{r['digest']}",
        "WARC-Refers-To": f"<urn:uuid:{uuid.UUID(int=r['leader'])}>" if again else None,
        "WARC-Profile": _PROFILE if again else None,
        "X-Page-Id": r["page_id"], "X-Payload-Length": len(payload),
        "X-Refers-To-Page-Id": r["refers_to"] if again else None,
        "Content-Type": "application/http; msgtype=response"}, http if again else http + payload)


def parse_record(member: bytes) -> tuple[dict, bytes]:
    """Named fields and payload of one gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _planned(pages: DataFrame, least: int) -> DataFrame:
    """Pages with the record that holds their payload, where several have it."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = materialize(pages.select(
        F.monotonically_increasing_id().alias("rid"), "page_id", "url",
        url_key(F.col("url")).alias("key"), payload.alias("payload"),
        F.sha1(payload).alias("digest"), F.sha2(payload, 256).alias("same")), "warc-pages")
    # the largest page_id of equal payloads; of rows that share it, one
    leaders = materialize(
        rows.where(F.octet_length("payload") >= least).groupBy("same").agg(
            F.max(F.struct("page_id", "rid")).alias("top"), F.count("*").alias("n"))
        .where("n > 1").select("same", F.col("top.page_id").alias("refers_to"),
                               F.col("top.rid").alias("leader")), "warc-leaders")
    # a payload of very many pages is dealt over SALTS parts of the join
    spread = leaders.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(
        spread, ["same", "salt"], "left").select(
        "rid", F.col("page_id").cast("string").alias("page_id"), "url", "key", "payload", "digest",
        "leader", F.col("refers_to").cast("string").alias("refers_to"))


def _archive_writer(folder: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            done: dict[str, list] = {"key": [], "file": [], "offset": [], "length": []}
            for r in batch.to_pylist():
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = _record("warcinfo", {"Content-Type": "application/warc-fields"},
                                   _named({"format": "WARC File Format 1.1"}))
                    out.write(info)
                    at = len(info)
                member = _page_record(r)
                out.write(member)
                for k, v in zip(done, (r["key"], name, at, len(member))):
                    done[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(done)
        if out is not None:
            out.close()
    return write


def _shard_writer(folder: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name = f"{uuid.uuid4().hex}.cdx"
        out, at, lines, held, directory = None, 0, [], 0, []
        first = last = b""

        def flush():
            nonlocal at, lines, held
            block = zlib.compress(b"".join(lines))
            out.write(block)
            directory.append(lines[0].split(b" ", 1)[0] + b" %d %d\n" % (at, len(block)))
            at, lines, held = at + len(block), [], 0

        for batch in batches:
            for r in batch.to_pylist():
                last = r["key"].encode()
                if out is None:
                    first, out = last, fs.open_output_stream(f"{root}/{name}", compression=None)
                line = b"%s %s %d %d\n" % (last, r["file"].encode(), r["offset"], r["length"])
                lines.append(line)
                held += len(line)
                if len(lines) >= block_lines or held >= BLOCK_BYTES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = zlib.compress(b"".join(directory))
        out.write(tail + struct.pack(_TRAILER, at, len(tail), _MARK))
        out.close()
        yield pa.RecordBatch.from_pydict({
            "shard": [name], "first": [first], "last": [last], "bytes": [at]})
    return write


def _tasks(size: int, per: int = TASK_BYTES) -> int:
    return max(1, math.ceil(size / per))


def archive(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES,
            archive_bytes: int = ARCHIVE_BYTES, shard_bytes: int = SHARD_BYTES,
            block_lines: int = BLOCK_LINES) -> Store:
    """Write one record per row of ``pages`` and the index of all of them.

    ``pages`` needs ``page_id, url, html``; other columns are ignored. The payload is the
    html in UTF-8; null is empty. Of equal payloads of ``least_bytes`` or more, the record
    with the largest ``page_id`` is a response and the others are revisits that refer to
    it; of rows sharing that ``page_id``, one is the response. A null ``page_id`` is below
    all others. Shorter payloads are responses each. No row is lost: repeated rows are
    records of their own, a null ``url`` has a key without host. No pages, no files.
    """
    captures = materialize(_planned(pages, least_bytes).mapInArrow(
        _archive_writer(folder, archive_bytes), _LOCATORS), "warc-captures")
    total = captures.agg(F.sum("length").alias("archives"), F.sum(
        F.octet_length("key") + 60).alias("lines")).first()
    order = ["key", "file", "offset"]
    shards = materialize(
        captures.repartitionByRange(_tasks(total.lines or 0, shard_bytes), *order)
        .sortWithinPartitions(*order).mapInArrow(
            _shard_writer(folder, block_lines),
            "shard string, first binary, last binary, bytes long"), "warc-shards")
    # one row for each SHARD_BYTES of lines: the top of the search
    listed = sorted((bytes(r.first), bytes(r.last), r.shard, r.bytes) for r in shards.collect())
    return Store(folder, listed, total.archives or 0, pages.schema["page_id"].dataType.simpleString())


def _directory(fs, root: str, shard: str) -> tuple[list, list]:
    """First keys and places of the blocks of a shard, by range reads at its end."""
    with fs.open_input_file(f"{root}/{shard}") as f:
        size = f.size()
        f.seek(size - struct.calcsize(_TRAILER))
        at, length, mark = struct.unpack(_TRAILER, f.read())
        if mark != _MARK:
            raise ValueError(f"{shard} is not an index shard")
        f.seek(at)
        rows = [x.split(b" ") for x in zlib.decompress(f.read(length)).splitlines()]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


def _block_finder(folder: str, shards: list):
    """Blocks that can hold a key: by the shards' last keys, then a shard's directory."""
    ends = [s[1] for s in shards]

    def places(key: bytes, read) -> Iterator[tuple]:
        i = bisect_left(ends, key)
        while i < len(shards) and shards[i][0] <= key:
            firsts, spots = read(shards[i][2])
            j = max(bisect_left(firsts, key) - 1, 0)
            while j < len(firsts) and firsts[j] <= key:
                yield shards[i][2], *spots[j]
                j += 1
            i += 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        held: dict = {}

        def read(shard):
            if shard not in held:
                if len(held) > 3:  # keys come in order, so shards do too
                    held.clear()
                held[shard] = _directory(fs, root, shard)
            return held[shard]

        out: list = []
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for place in places(key.encode(), read):
                    out.append((key, *place))
                    if len(out) >= 4096:
                        yield _rows(out, ["key", "shard", "at", "length"])
                        out = []
        if out:
            yield _rows(out, ["key", "shard", "at", "length"])
    return find


def _rows(rows: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))


def _block_reader(folder: str):
    """Lines of the keys asked for; every block is read once for all of its keys."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        at, keys, lines, file, name = None, [], [], None, None
        names = ["key", "file", "offset", "length"]
        out: list = []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["shard"], r["at"]) != at:
                    at = r["shard"], r["at"]
                    if name != r["shard"]:
                        name, file = r["shard"], fs.open_input_file(f"{root}/{r['shard']}")
                    file.seek(r["at"])
                    lines = zlib.decompress(file.read(r["length"])).splitlines()
                    keys = [x.split(b" ", 1)[0] for x in lines]
                key = r["key"].encode()
                i = bisect_left(keys, key)
                while i < len(keys) and keys[i] == key:
                    _, where, offset, length = lines[i].split(b" ")
                    out.append((r["key"], where.decode(), int(offset), int(length)))
                    i += 1
                    if len(out) >= 4096:
                        yield _rows(out, names)
                        out = []
        if out:
            yield _rows(out, names)
    return read


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """Places of all captures of the keys in column ``key``: ``key, file, offset, length``.

    Keys are asked once each, whatever their number in ``keys``; null is no key. A key
    with very many captures spans many blocks, which are dealt over tasks.
    """
    asked = keys.select("key").where("key IS NOT NULL").distinct()
    if not store.shards:
        return asked.select("key", F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"),
                            F.lit(0).cast("long").alias("length")).limit(0)
    blocks = asked.repartitionByRange(len(store.shards), "key").sortWithinPartitions(
        "key").mapInArrow(_block_finder(store.folder, store.shards),
                          "key string, shard string, at long, length long")
    dealt = blocks.repartition(_tasks(sum(s[3] for s in store.shards), TASK_BYTES // 8),
                               "shard", "at")
    return dealt.sortWithinPartitions("shard", "at", "key").mapInArrow(
        _block_reader(store.folder), _LOCATORS)


def _record_reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, file = r["file"], fs.open_input_file(f"{root}/{r['file']}")
                file.seek(r["offset"])
                fields, payload = parse_record(file.read(r["length"]))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {r['offset']}: payload and digest differ")
                rows.append((
                    r["key"], fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), kind, digest,
                    int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload),
                    fields.get("X-Refers-To-Page-Id"),
                    payload if with_payload and kind == "response" else None))
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["key", "page_id", "target_uri", "record_type", "payload_digest",
                 "payload_bytes", "refers_to", "payload"])
    return read


def read_records(store: Store, places: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records at ``places``, by range reads in the order of the archives.

    A response's digest is computed again from what was read. ``payload`` is null unless
    asked for, and for revisits, which hold none: their length and digest are those of
    the full payload.
    """
    near = F.floor(F.col("offset") / (TASK_BYTES // 4))
    rows = places.repartition(_tasks(store.archive_bytes), "file", near).sortWithinPartitions(
        "file", "offset")
    found = rows.mapInArrow(
        _record_reader(store.folder, with_payload),
        "key string, page_id string, target_uri string, record_type string, "
        "payload_digest string, payload_bytes long, refers_to string, payload binary")
    return found.withColumn("page_id", F.col("page_id").cast(store.page_type)).withColumn(
        "refers_to", F.col("refers_to").cast(store.page_type))
