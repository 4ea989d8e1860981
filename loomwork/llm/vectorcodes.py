"""Vector codes: integer parts, one codebook per part position, active-entry Lloyd.

A part keeps the exact distance to its entry. After a round only entries that moved can
have come nearer to a part whose own entry stayed fixed, so that part compares those
with the distance it kept; parts whose entry moved compare all entries. Ties go to the
lower index in both cases, so codes equal those of full rescans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SALTS = 16
_NARROW = 1 << 20   # components below this are exact in 64-bit arithmetic
_LIMB = 32          # bits of a piece of a sum


def edges(width: int) -> list[int]:
    """Where the parts of a vector begin, and its end; equal parts if 16 divides it."""
    return [i * width // PARTS for i in range(PARTS + 1)]


def _integers(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Components as integers: 64-bit where exact, otherwise Python's own."""
    if not x.size or (np.abs(x).max() < _NARROW and book.dtype != object):
        return x.astype(np.int64)
    return np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, exact."""
    if x.dtype == object:
        d = x[:, None, :] - entries.astype(object)[None, :, :]
        return (d * d).sum(axis=2) if x.shape[1] else np.zeros(d.shape[:2], object)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None = None,
           codes: np.ndarray | None = None, kept: np.ndarray | None = None,
           tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its squared distance for every row and part.

    ``book`` is entries x width, ``moved`` parts x entries: the entries changed since
    ``codes`` and the exact distances ``kept`` were found. ``tally`` counts distances.
    """
    at = edges(x.shape[1])
    new = np.zeros((len(x), PARTS), np.int64)
    far = np.zeros((len(x), PARTS), x.dtype)
    for p in range(PARTS):
        xs, entries = x[:, at[p]:at[p + 1]], book[:, at[p]:at[p + 1]]
        full = np.arange(len(x))
        if codes is not None:
            new[:, p], far[:, p] = codes[:, p], kept[:, p]
            full = np.flatnonzero(moved[p][codes[:, p]])
            fixed, active = np.flatnonzero(~moved[p][codes[:, p]]), np.flatnonzero(moved[p])
            if len(fixed) and len(active):
                d = _distances(xs[fixed], entries[active])
                low = d.argmin(axis=1)
                best, entry = d[np.arange(len(fixed)), low], active[low]
                mine, own = far[fixed, p], new[fixed, p]
                better = ((best < mine) | ((best == mine) & (entry < own))).astype(bool)
                new[fixed[better], p], far[fixed[better], p] = entry[better], best[better]
                if tally is not None:
                    tally["active"] = tally.get("active", 0) + d.size
        if len(full):
            d = _distances(xs[full], entries)
            new[full, p] = d.argmin(axis=1)
            far[full, p] = d[np.arange(len(full)), new[full, p]]
            if tally is not None:
                tally["full"] = tally.get("full", 0) + d.size
    return new, far


class _Sums:
    """Sums of components and counts by entry, of one task: entries x width numbers."""

    def __init__(self, entries: int, width: int):
        self.sums = np.zeros((entries, width), object)
        self.counts = np.zeros((PARTS, entries), np.int64)
        self.at = edges(width)

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        for p in range(PARTS):
            self.counts[p] += np.bincount(codes[:, p], minlength=len(self.sums))
            part = np.zeros((len(self.sums), self.at[p + 1] - self.at[p]), x.dtype)
            np.add.at(part, codes[:, p], x[:, self.at[p]:self.at[p + 1]])
            self.sums[:, self.at[p]:self.at[p + 1]] += part.astype(object)

    def rows(self) -> Iterator[tuple]:
        """(component or -1 - part for counts, entry, limb, number): long numbers in limbs."""
        for p, e in np.argwhere(self.counts):
            yield -1 - int(p), int(e), 0, int(self.counts[p, e])
        for e, j in np.argwhere(self.sums != 0):
            value, limb = int(self.sums[e, j]), 0
            while not -(1 << 62) < value < 1 << 62:
                yield int(j), int(e), limb, value & ((1 << _LIMB) - 1)
                value, limb = value >> _LIMB, limb + 1
            yield int(j), int(e), limb, value


_SUMS = "component int, entry int, limb int, number long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without null rows as rows x width numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    out = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))
    if valid is None or valid.all():
        return out
    return pc.if_else(pa.array(valid), out, pa.nulls(len(rows), out.type))


def _step(book: np.ndarray, moved: np.ndarray | None):
    """Assign the vectors of a task; the last rows it gives are its sums."""
    width = book.shape[1]
    names = ["vec_id", "label", "vec", "codes", "kept", "component", "entry", "limb", "number"]
    plain = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def reassigned(batch: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, far = np.zeros((len(x), PARTS), np.int64), np.zeros((len(x), PARTS), x.dtype)
        held = batch.column("kept").is_valid().to_numpy(zero_copy_only=False)
        known, lost = np.flatnonzero(held), np.flatnonzero(~held)
        if len(known):
            rows = batch.take(pa.array(known))
            codes[known], far[known] = assign(
                x[known], book, moved, _matrix(rows.column("codes"), PARTS).astype(np.int64),
                _matrix(rows.column("kept"), PARTS).astype(x.dtype))
        if len(lost):
            codes[lost], far[lost] = assign(x[lost], book)
        return codes, far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = _Sums(len(book), width), None
        for batch in batches:
            types = [batch.column(n).type for n in names[:3]]
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            x = _integers(flat.reshape(batch.num_rows, width), book)
            codes, far = assign(x, book) if moved is None else reassigned(batch, x)
            sums.add(x, codes)
            exact = (far < 1 << 62).all(axis=1).astype(bool)  # beyond: found anew each time
            far = np.where(exact[:, None], far, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(n) for n in names[:3]], _lists(codes, pa.int32()),
                _lists(far, pa.int64(), exact),
                *[pa.nulls(batch.num_rows, t) for t in plain]], names)
        rows = list(sums.rows())
        if rows:
            empty = [*types, pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(len(rows), t) for t in empty],
                *[pa.array(c, t) for c, t in zip(zip(*rows), plain)]], names)
    return run


def _updated(book: np.ndarray, sums: list) -> np.ndarray:
    """Entries as floors of means; unused ones stay. ``sums``: at most entries x width rows."""
    at, counts, totals = edges(book.shape[1]), {}, {}
    for r in sums:
        if r.component < 0:
            counts[-1 - r.component, r.entry] = int(r.number)
        else:
            key = r.component, r.entry
            totals[key] = totals.get(key, 0) + (int(r.number) << (_LIMB * r.limb))
    out = book.astype(object)
    for (p, e), n in counts.items():
        for j in range(at[p], at[p + 1]):
            out[e, j] = totals.get((j, e), 0) // n
    return _narrowed(out)


def _narrowed(book: np.ndarray) -> np.ndarray:
    small = all(abs(int(v)) < _NARROW for v in book.ravel())
    return book.astype(np.int64) if small else book.astype(object)


def _digest(book: np.ndarray) -> str:
    at = edges(book.shape[1])
    return hashlib.sha256(",".join(
        str(int(v)) for p in range(PARTS) for r in book[:, at[p]:at[p + 1]] for v in r
    ).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Codes of all vectors: ``vec_id, code, error, label_error, codebooks_sha256``.

    ``vectors`` needs ``vec_id, embedding, label``; other columns are ignored. Rows whose
    vector is null or holds a null or non-finite component are left out (so is one whose
    256-fold is beyond a double). The codebooks start as the parts of the vectors of the
    ``entries`` smallest ids, null last; of several vectors with one id, the smallest.
    Repeated rows stay. The width is that of the smallest id's vector; vectors of another
    width get null codes and errors and take no part. Parts of a width that 16 does not
    divide differ by one component; an empty vector is all zeros. Components of any size
    are exact; an error that no long holds is null, and so is the sum of its label. An
    empty table gives no rows.

    The driver holds the codebooks, entries x width numbers, and their sums; tasks give
    the same number of sums each, added up by a hash aggregate.
    """
    scaled = F.transform("embedding", lambda v: _floor(v.cast("double") * F.lit(float(SCALE))))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = materialize(vectors.select("vec_id", "label", scaled.alias("vec")).where(
        F.col("vec").isNotNull() & fine), "vectors")
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(
        F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return _labelled(rows, [], "")
    match = F.coalesce(F.col("vec_id").isin([i for i in ids if i is not None]), F.lit(None in ids))
    firsts = {r.vec_id: r.vec for r in rows.where(match).groupBy("vec_id").agg(
        F.min("vec").alias("vec")).collect()}
    width = len(firsts[ids[0]])
    starts = [[int(v) for v in firsts[i]] for i in ids if len(firsts[i]) == width]
    book, moved = _narrowed(np.array(starts, object).reshape(len(starts), width)), None
    nothing = [F.lit(None).cast(t).alias(n)
               for n, t in (("codes", "array<int>"), ("kept", "array<bigint>"))]
    state, at = rows.where(F.size("vec") == width).select("*", *nothing), edges(width)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    for step in range(rounds + 1):
        found = materialize(state.mapInArrow(_step(book, moved), f"{schema}, {_SUMS}"), "codes")
        state = found.where("entry IS NULL").select("vec_id", "label", "vec", "codes", "kept")
        if step < rounds:
            after = _updated(book, found.where("entry IS NOT NULL").groupBy(
                "component", "entry", "limb").agg(F.sum("number").alias("number")).collect())
            moved = np.array([[any(book[e, j] != after[e, j] for j in range(at[p], at[p + 1]))
                               for e in range(len(book))] for p in range(PARTS)])
            book = after
    other = rows.where(F.size("vec") != width).select("*", *nothing)
    return _labelled(state.unionByName(other), ["codes", "kept"], _digest(book))


def _floor(x: Column) -> Column:
    """The floor as a double; beyond 2**52 every double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _labelled(state: DataFrame, found: list[str], digest: str) -> DataFrame:
    """Codes as text, errors, and errors of whole labels."""
    if not found:
        return state.select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    big = "decimal(38,0)"
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("kept", F.lit(0).cast(big), lambda a, k: (a + k).cast(big))
    coded = materialize(state.select(
        "vec_id", "label", code.alias("code"), error.try_cast("long").alias("error")), "coded")
    # a label of very many rows is dealt over SALTS parts of the join
    lost = F.max((F.col("code").isNotNull() & F.col("error").isNull()).cast("int"))
    whole = materialize(coded.groupBy("label").agg(
        F.sum(F.col("error").cast(big)).alias("total"), lost.alias("lost")).select(
        F.col("label").alias("same"), F.when(F.col("lost") == 0, F.col("total")).try_cast(
            "long").alias("label_error")), "label-errors")
    spread = whole.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    dealt = coded.withColumn("salt", F.pmod(F.hash("vec_id", "code"), F.lit(SALTS)))
    return dealt.join(spread, dealt["label"].eqNullSafe(spread["same"]) & (
        dealt["salt"] == spread["part"]), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
