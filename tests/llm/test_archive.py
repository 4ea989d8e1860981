"""Archives, vector codes and conversation prefixes against brute force and edge cases."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import prefixtrie, vectorcodes, warc
from loomwork.session import scratch_path

# --- archives ------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, file string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES)


def expected(rows, least):
    """(page_id, bytes, digest, type, refers_to) of every row, as a sorted list."""
    groups, out = defaultdict(list), []
    for n, (i, _, h) in enumerate(rows):
        groups[(h or "").encode()].append((i if i is not None else -1 << 70, n))
    for payload, held in groups.items():
        top = max(held)
        for i, n in held:
            again = len(payload) >= least and len(held) > 1 and (i, n) != top
            out.append((rows[n][0], len(payload), hashlib.sha1(payload).hexdigest(),
                        "revisit" if again else "response",
                        rows[top[1]][0] if again else None))
    return sorted(out, key=str)


def read_all(spark, rows, with_payload=False, **small):
    table = pages(spark, rows)
    store = warc.archive(table, scratch_path(spark, "warc"), **small)
    places = warc.lookup(store, table.select(warc.url_key(F.col("url")).alias("key")))
    return store, warc.read_records(store, places, with_payload)


BIG = "<p>équal</p>" * 200
WEB = [
    (1, "http://www.a.org/x", BIG), (7, "https://b.a.org/y?q=1#f", BIG), (7, "http://c.org", BIG),
    (None, "http://c.org/", BIG), (3, None, None), (4, "", ""), (5, "no scheme at all", "short"),
    (5, "no scheme at all", "short"), (None, None, "x" * 999), (9, None, "x" * 999),
    (10, "http://ü.de/ü\r\nX-Page-Id: 1 \x00", "header: trap\r\n\r\nbody\r\n\r\n"),
    (11, "http://long.org/" + "p" * 50000, "é" * 60000)] + [
    (100 + i, f"http://hot.org/{i % 7}", f"page {i}") for i in range(60)]


@pytest.mark.parametrize("small", [
    {}, {"archive_bytes": 500, "shard_bytes": 900, "block_lines": 3}])
def test_archive_round_trip(spark, small):
    _, found = read_all(spark, WEB, with_payload=True, **small)
    rows = found.collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in rows), key=str)
    assert got == expected(WEB, warc.LEAST_BYTES)
    kept = sorted(r.payload.decode() for r in rows if r.record_type == "response")
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert len(revisits) == 3 and all(r.payload is None and r.refers_to == 7 for r in revisits)
    assert kept == sorted([h or "" for _, _, h in WEB if h != BIG] + [BIG])


def test_archive_least_bytes_and_files(spark):
    store, found = read_all(spark, WEB, least_bytes=5)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in found.collect()), key=str)
    assert got == expected(WEB, 5)
    # any reader of gzip members sees whole records, one after another
    for file in (x.split("file:")[-1] for x in spark.read.format("binaryFile").load(
            store.folder + "/*.warc.gz").select("path").toPandas()["path"]):
        text = gzip.open(file).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")


def test_archive_lookup(spark):
    store, _ = read_all(spark, WEB, archive_bytes=500, shard_bytes=900, block_lines=3)
    assert len(store.shards) > 1
    asked = spark.createDataFrame(
        [("org,hot)/3",), ("org,hot)/3",), ("org,hot)/31",), ("",), ("zzz",), (None,)], "key string")
    found = warc.read_records(store, warc.lookup(store, asked)).collect()
    assert sorted(r.page_id for r in found) == [100 + i for i in range(60) if i % 7 == 3]


def test_archive_hot_payload_and_empty(spark):
    rows = [(i, f"http://x.org/{i}", BIG) for i in range(400)] + [(1000, "http://y.org", "y")]
    _, found = read_all(spark, rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in found.collect()), key=str) == expected(rows, warc.LEAST_BYTES)
    store = warc.archive(pages(spark, WEB).limit(0), scratch_path(spark, "warc"))
    keys = spark.createDataFrame([("a",)], "key string")
    assert store.shards == [] and warc.read_records(store, warc.lookup(store, keys)).count() == 0


def test_url_key(spark):
    urls = [("HTTP://u:p@WWW.Example.ORG:80/A?b=http://x.y/#frag", "org,example,www)/A?b=http://x.y/"),
            ("http://a.b", "b,a)/"), (None, ")/"), ("//h.i/j k", "i,h)/j%20k"), ("plain", ")plain")]
    got = spark.createDataFrame(urls, "url string, want string").select(
        "want", warc.url_key(F.col("url")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


# --- vector codes --------------------------------------------------------------------

def plain_codes(rows, rounds=2, entries=64):
    """Full rescans in Python's own integers: {row: (code, error)} and the digest."""
    import math
    whole = {n: [math.floor(256 * float(np.float32(v))) for v in vec]
             for n, (_, vec, _) in enumerate(rows)
             if vec is not None and all(v is not None and math.isfinite(v) for v in vec)}
    firsts = {}
    for n, vec in whole.items():
        i = rows[n][0] if rows[n][0] is not None else 1 << 70
        firsts[i] = min(firsts.get(i, vec), vec)
    ids = sorted(firsts)[:entries]
    if not ids:
        return {}, ""
    width = len(firsts[ids[0]])
    book = [list(firsts[i]) for i in ids if len(firsts[i]) == width]
    whole = {n: v for n, v in whole.items() if len(v) == width}
    at = vectorcodes.edges(width)
    for step in range(rounds + 1):
        near = {}
        for n, vec in whole.items():
            for p in range(16):
                part = slice(at[p], at[p + 1])
                near[n, p] = min((sum((a - b) ** 2 for a, b in zip(vec[part], entry[part])), e)
                                 for e, entry in enumerate(book))
        if step == rounds:
            break
        new = [list(b) for b in book]
        for p in range(16):
            for e in range(len(book)):
                held = [whole[n] for n in whole if near[n, p][1] == e]
                for j in range(at[p], at[p + 1]) if held else ():
                    new[e][j] = sum(v[j] for v in held) // len(held)
        book = new
    digest = hashlib.sha256(",".join(
        str(v) for p in range(16) for b in book for v in b[at[p]:at[p + 1]]).encode()).hexdigest()
    return {n: ("".join(f"{near[n, p][1]:02x}" for p in range(16)),
                sum(near[n, p][0] for p in range(16))) for n in whole}, digest


VECTORS = "vec_id long, embedding array<float>, label int, code string, salt int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], VECTORS)


def check_codes(spark, rows):
    want, digest = plain_codes(rows)
    errors = defaultdict(int)
    for n, (_, error) in want.items():
        errors[rows[n][2]] += error
    fit = lambda x: x if x < 1 << 63 else None
    got = [r for r in vectorcodes.encode(vectors(spark, rows)).collect() if r.code is not None]
    assert sorted((str(r.vec_id), r.code, str(r.error), str(r.label_error)) for r in got) == sorted(
        (str(rows[n][0]), code, str(fit(error)), str(fit(errors[rows[n][2]])))
        for n, (code, error) in want.items())
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())


@pytest.mark.parametrize("width", [32, 40])
def test_vector_codes(spark, width):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, width)) / 8
    rows = [(int(i), (centres[i % 9] + rng.normal(size=width) / 99).astype("f4").tolist(),
             None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [(3, rows[0][1], 1), (None, rows[1][1], 1), (7, None, 1), (8, [float("nan")] * width, 2),
             (9, [None] * width, 2), (500, rows[2][1], 2), (500, rows[2][1], 2)]
    check_codes(spark, rows)


def test_vector_codes_edges(spark):
    check_codes(spark, [(1, [0.5] * 16, None), (2, [0.25] * 16, None), (2, [0.5] * 16, 4)])
    check_codes(spark, [(1, [], 1), (2, [], None)])
    check_codes(spark, [(1, None, 1)])
    # components far beyond 64 bits; errors that no long holds
    check_codes(spark, [(i, [3e38 if (i + j) % 3 == 0 else -1e30 * i - j for j in range(16)], i % 2)
                        for i in range(70)] + [(99, [0.125] * 16, 5)])
    mixed = vectorcodes.encode(vectors(spark, [(1, [0.5] * 16, 1), (2, [0.5] * 17, 1)])).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in mixed) == [(1, "00" * 16, 0), (2, None, None)]
    assert vectorcodes.encode(vectors(spark, [(1, None, 1)]).limit(0)).count() == 0


def test_active_entries_compare_less():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-99, 99, (500, 32)), rng.integers(-99, 99, (64, 32))
    codes, far = vectorcodes.assign(x, book)
    after, moved = book.copy(), np.zeros((16, 64), bool)
    after[5] += 3
    after[9] = after[2]  # a tie: the lower index wins
    moved[:, [5, 9]] = True
    tally: dict = {}
    got = vectorcodes.assign(x, after, moved, codes, far, tally)
    want = vectorcodes.assign(x, after)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert tally["active"] + tally["full"] < 500 * 16 * 64 / 8


# --- prefix trie ---------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, seq string, part int"


def plain_trie(rows, every=100, modulus=6):
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in said.items()}
    seqs = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % modulus
        seqs[c] = tuple(said.get(c - c % every, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    out = []
    for node, inside in members.items():
        below = [m for m in members if m[:len(node)] == node]
        leaves = sum(not any(len(k) == len(m) + 1 and k[:-1] == m for k in members) for m in below)
        ends = ",".join(map(str, sorted(c for c in inside if seqs[c] == node)))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside),
            sum(len(m) == len(node) + 1 for m in below), leaves,
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def talk(seed, convs, hot):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        length = rng.choice([0, 1, 2, 3, 6, 9]) if c % 100 else 6
        for t in range(length):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, t, role if not hot or t else "user", rng.choice(["a", "b", "é🙂", None, ""])
                         if t or not hot else "hello"))
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 1 << 17])
@pytest.mark.parametrize("hot", [False, True])
def test_prefix_trie(spark, shard_turns, hot):
    rows = talk(3, [*range(60), *range(100, 130), *range(230, 250)], hot)
    got = prefixtrie.prefix_trie(chats(spark, rows), shard_turns).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_prefix_trie_edges(spark):
    rows = [(1, None, "user", "x"), (1, 0, "user", "y"), (2, 5, None, None), (2, 5, None, None),
            (None, 1, "user", "z"), (300, 1, "u", "same"), (301, 1, "u", "same"),
            *[(700, t, "u", f"turn {t}") for t in range(300)],
            *[(c, 1, "user", "copy") for c in range(800, 860)], (900, 1, "u", "w" * 90000)]
    got = prefixtrie.prefix_trie(chats(spark, rows), 50).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)
    assert prefixtrie.prefix_trie(chats(spark, rows).limit(0)).count() == 0
    alone = [(3, 1, "u", "t")]  # fewer turns than its h: nothing is left of it
    got = prefixtrie.prefix_trie(chats(spark, alone)).collect()
    assert [tuple(r) for r in got] == plain_trie(alone) and got[0].n_leaves == 1


def test_long_lists_of_members(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE_BYTES", 20)
    members = spark.createDataFrame([(i, "") for i in range(5000)], "conv_id long, seq string")
    root = prefixtrie.trie(members).collect()
    assert len(root) == 1 and root[0].n_convs == 5000
    assert root[0].ends_sha256 == hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400))
def test_find_close(steps):
    opens, depth = [True], 1
    for s in steps:  # a walk that never leaves the root
        if s and depth > 1:
            opens.append(False)
            depth -= 1
        else:
            opens.append(True)
            depth += 1
    opens = np.array(opens + [False] * depth)
    stack, want = [], {}
    for i, o in enumerate(opens.tolist()):
        if o:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = prefixtrie.Parens(opens)
    got = tree.find_close(tree.first)
    assert dict(zip(tree.first.tolist(), got.tolist())) == want
