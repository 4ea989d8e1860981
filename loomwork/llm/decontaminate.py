"""Find benchmark passages in documents with one Aho-Corasick automaton."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.steps import bound_batches, materialize

WINDOW_WORDS = 10
AUTOMATON_CHARS = 2_000_000  # text of the windows in one automaton
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
_SPAN = "array<struct<start:int,end:int>>"
_built: dict[str, tuple] = {}


def fold(text) -> F.Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """``(window, items, block)``: distinct windows, the items they stand in as sorted
    text, and a block number such that a block's windows fit one automaton."""
    word = F.regexp_extract_all(fold(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    found = (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                     word.alias("words"))
        .where(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.concat_ws(" ", F.slice("words", F.col("at") + 1, width)).alias("window"))
        .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")))
    found = materialize(found, "windows")
    chars = found.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    blocks = max(1, -(-2 * chars // AUTOMATON_CHARS))
    return found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))


def _automaton(key: str, windows_of_block) -> tuple:
    """The automaton of a block, built once per worker process."""
    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        widths, items = [], []
        for text, owners in windows_of_block:
            found.add_word(f" {text} ", len(items))
            widths.append(len(text) + 1)
            items.append(owners)
        if items:
            found.make_automaton()
        _built[key] = (found if items else None, widths, items)
    return _built[key]


def _scan(text: str, automaton, widths, items) -> tuple[int, list, list, list]:
    """Number of words, hit words as ``[first, last)`` runs, their spans, items found."""
    raw = text.encode()
    words = raw.translate(_TABLE).split()
    if automaton is None or not words:
        return len(words), [], [], []
    line = f" {b' '.join(words).decode()} "
    hits = [(end, which) for end, which in automaton.iter(line)]
    if not hits:
        return len(words), [], [], []
    # position of each word in the joined line, then in the text
    sizes = np.fromiter((len(w.decode()) for w in words), np.int64, len(words))
    begins = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))[:-1]
    runs: list[list[int]] = []
    spans = sorted((int(np.searchsorted(begins, end - widths[which] + 0)),
                    int(np.searchsorted(begins, end))) for end, which in hits)
    for first, last in spans:
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    # bytes that go on a character do not count as code points
    points = np.concatenate(
        ([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    original = [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]
    found = sorted({owner for _, which in hits for owner in items[which]})
    return len(words), runs, original, found


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanner(block, key: str, carried: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(key, block.value)
        for batch in batches:
            rows = [_scan(t or "", *machine) for t in batch.column("_text").to_pylist()]
            fresh = {
                "_n_words": pa.array([r[0] for r in rows], pa.int64()),
                "_runs": pa.array(
                    [[{"start": a, "end": b} for a, b in r[1]] for r in rows], _SPANS),
                "_spans": pa.array(
                    [[{"start": a, "end": b} for a, b in r[2]] for r in rows], _SPANS),
                "_items": pa.array([r[3] for r in rows], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in carried), *fresh.values()], [*carried, *fresh])
    return scan


def _merged(runs: F.Column) -> F.Column:
    """Sorted runs with those that overlap or touch made one."""
    def add(done, run):
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"),
                             F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (run["start"] <= F.try_element_at(
            done, F.lit(-1))["end"]), grown).otherwise(F.concat(done, F.array(run)))
    return F.aggregate(F.array_sort(runs), F.array().cast(_SPAN), add)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS,
                  keep: list[str] | None = None) -> DataFrame:
    """Benchmark windows that stand in every document.

    Texts are normalised the same way on both sides: A-Z in lower case, words of
    digits, letters a-z and all characters beyond ASCII. A window is ``width``
    words in a row of an item, or the whole of a shorter one. All windows are one
    automaton that scans each document once; hit words are mapped back to code
    points of the text as it was. Benchmarks whose windows have more text than
    ``AUTOMATON_CHARS`` are dealt over several automata, and documents pass them
    one after another, so a worker's memory and each broadcast stay bounded.

    ``docs`` needs ``text`` and ``items`` needs ``item_id, text``. Returns every
    row of ``docs`` with its columns (or those in ``keep``) and ``hits``: a struct of
    ``n_words``, ``runs`` (hit words, end exclusive), ``spans`` (the same in code
    points) and ``items`` (identifiers as text, sorted). Null or empty texts have no
    words and no hits; a null identifier is an empty text; repeated items count
    once; an empty benchmark hits nothing; ``docs`` may have columns of any name but
    ``hits``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    found = windows(items, width)
    blocks = [r[0] for r in found.select("block").distinct().orderBy("block").collect()] or [0]
    columns = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                       F.col("text").alias("_text"))
    fresh = f"_n_words long, _runs {_SPAN}, _spans {_SPAN}, _items array<string>"
    for k, number in enumerate(blocks):
        last = k + 1 == len(blocks)
        part = [(r["window"], r["items"]) for r in
                found.where(F.col("block") == number).collect()]  # one automaton's worth
        block = spark.sparkContext.broadcast(part)
        carried = ["_row", *(["_hits"] if k else []), *([] if last else ["_text"])]
        schema = T.StructType([f for f in rows.schema if f.name in carried]
                              + T.StructType.fromDDL(fresh).fields)
        carried = [f.name for f in schema if f.name in carried]
        scanned = rows.mapInArrow(_scanner(block, uuid.uuid4().hex, carried), schema)
        earlier = F.col("_hits") if k else F.struct(
            F.array().cast(_SPAN).alias("runs"), F.array().cast(_SPAN).alias("spans"),
            F.array().cast("array<string>").alias("items"))
        join = lambda name: F.col(f"_{name}") if not k else _merged(
            F.concat(earlier[name], F.col(f"_{name}")))
        hits = F.struct(
            F.col("_n_words").alias("n_words"), join("runs").alias("runs"),
            join("spans").alias("spans"),
            F.array_sort(F.array_union(earlier["items"], F.col("_items"))).alias("items"))
        rows = scanned.select("_row", *([] if last else ["_text"]), hits.alias("_hits"))
        if not last:
            rows = materialize(rows, "scanned")
    return rows.select("_row.*", F.col("_hits").alias("hits"))


def hit_words(hits: F.Column) -> F.Column:
    return F.aggregate(hits["runs"], F.lit(0).cast("long"),
                       lambda n, r: n + (r["end"] - r["start"]))
