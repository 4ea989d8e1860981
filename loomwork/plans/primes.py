"""Number ranges: segments of a range and the primes in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.projections import numbered

SEGMENT = 1 << 20


def equal_segments(requests: DataFrame, parts: int, request: str = "request",
                   start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Each range cut into ``parts`` equal segments, the last one taking the remainder.

    A range with fewer numbers than parts gives empty segments (``hi < lo``)
    before the last; a range with ``start > end`` gives none.
    """
    lo, hi = F.col(start).cast("long"), F.col(end).cast("long")
    length = F.floor((hi - lo + 1) / F.lit(parts)).cast("long")
    seg = F.col("segment")
    ranges = requests.where(lo <= hi).select(
        request, lo.alias("__s"), hi.alias("__e"), length.alias("__n"),
        F.lit(0).cast("long").alias("__first"), F.lit(parts - 1).cast("long").alias("__last"))
    return numbered(ranges, "__first", "__last", "segment", [request]).select(
        request, seg.cast("int").alias("segment"), (F.col("__s") + seg * F.col("__n")).alias("lo"),
        F.when(seg == parts - 1, F.col("__e"))
        .otherwise(F.col("__s") + (seg + 1) * F.col("__n") - 1).alias("hi"))


def fixed_segments(requests: DataFrame, size: int = SEGMENT, request: str = "request",
                   start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Each range cut into segments of ``size`` numbers, the last one shorter."""
    lo, hi = F.col(start).cast("long"), F.col(end).cast("long")
    ranges = requests.where(lo <= hi).select(
        request, lo.alias("__s"), hi.alias("__e"), F.lit(0).cast("long").alias("__first"),
        F.call_function("div", hi - lo, F.lit(size).cast("long")).alias("__last"))
    return numbered(ranges, "__first", "__last", "segment", [request]).select(
        request, "segment", (F.col("__s") + F.col("segment") * size).alias("lo"),
        F.least(F.col("__e"), F.col("__s") + (F.col("segment") + 1) * size - 1).alias("hi"))


def grid_segments(requests: DataFrame, size: int = SEGMENT, request: str = "request",
                  start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Each range cut at the multiples of ``size``; ranges share their grid cells' numbers."""
    lo, hi = F.col(start).cast("long"), F.col(end).cast("long")
    cell = lambda n: F.floor(n / F.lit(size)).cast("long")
    if size & (size - 1) == 0:  # exact for all numbers
        cell = lambda n: F.shiftright(n, size.bit_length() - 1)
    ranges = requests.where(lo <= hi).select(
        request, lo.alias("__s"), hi.alias("__e"), cell(lo).alias("__first"), cell(hi).alias("__last"))
    return numbered(ranges, "__first", "__last", "segment", [request]).select(
        request, "segment", F.greatest(F.col("__s"), F.col("segment") * size).alias("lo"),
        F.least(F.col("__e"), (F.col("segment") + 1) * size - 1).alias("hi"))


def _small_primes(limit: int) -> np.ndarray:
    flags = np.ones(max(limit + 1, 2), dtype=bool)
    flags[:2] = False
    for p in range(2, int(limit ** 0.5) + 1):
        if flags[p]:
            flags[p * p::p] = False
    return np.flatnonzero(flags).astype(np.int64)


def _sieve(lo: int, hi: int, base: np.ndarray) -> np.ndarray:
    """Primes in ``[lo, hi]``, given all primes up to the square root of ``hi``."""
    lo = max(lo, 2)
    if hi < lo:
        return np.empty(0, dtype=np.int64)
    flags = np.ones(hi - lo + 1, dtype=bool)
    base = base[base * base <= hi]
    first = np.maximum(base * base, -(-lo // base) * base) - lo
    dense = base < 4096
    for p, f in zip(base[dense], first[dense]):
        flags[f::p] = False
    at, step = first[~dense], base[~dense]
    while at.size:
        keep = at < flags.size
        at, step = at[keep], step[keep]
        flags[at] = False
        at = at + step
    return np.flatnonzero(flags).astype(np.int64) + lo


def _base_for(hi: int, base: np.ndarray) -> np.ndarray:
    root = int(max(hi, 0) ** 0.5) + 1
    return base if base.size and base[-1] >= root else _small_primes(root + 1000)


def _sieve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = _small_primes(1)
    for batch in batches:
        lows = batch.column("lo").to_pylist()
        highs = batch.column("hi").to_pylist()
        for request, lo, hi in zip(batch.column("request"), lows, highs):
            base = _base_for(hi, base)
            primes = _sieve(lo, hi, base)
            if primes.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(request, primes.size), pa.array(primes)], ["request", "prime"])


def _sieve_cells(once: bool):
    """Primes of pieces sorted by cell and start: each number is sieved once.

    What a cell's pieces have in common is sieved for the first of them and kept for
    the others, no longer than the cell. With ``once`` a sweep over the pieces gives every
    prime one time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, cell, known, upto, given = _small_primes(1), None, [], 0, 0
        for batch in batches:
            for i, (now, lo, hi) in enumerate(zip(*(
                    batch.column(c).to_pylist() for c in ("segment", "lo", "hi")))):
                lo = max(lo, 2)
                if now != cell:
                    cell, known, upto, given = now, np.empty(0, np.int64), lo - 1, lo - 1
                if hi > upto:  # pieces come by their start, so only the end can be new
                    base = _base_for(hi, base)
                    known = np.concatenate((known, _sieve(max(upto + 1, lo), hi, base)))
                    upto = hi
                first = max(lo, given + 1) if once else lo
                found = known[np.searchsorted(known, first):np.searchsorted(known, hi, "right")]
                given = max(given, hi)
                if found.size:
                    primes = pa.array(found)
                    yield pa.RecordBatch.from_arrays([primes], ["prime"]) if once else (
                        pa.RecordBatch.from_arrays(
                            [pa.repeat(batch.column("request")[i], found.size), primes],
                            ["request", "prime"]))
    return run


def _by_cell(requests: DataFrame, segment: int) -> DataFrame:
    spark = requests.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    return grid_segments(requests.where("range_end >= 2"), segment).repartition(
        tasks, "segment").sortWithinPartitions("segment", "lo", "hi")


def primes_in_ranges(requests: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(request, prime)`` for ranges ``(request, range_start, range_end)``, both
    ends included. Numbers below 2 are not prime.

    Ranges are cut at the same places, and pieces of the same cell meet in one task, which
    sieves it once for all of them. Numbers are never shuffled. A range of any length
    is many small pieces, never one long task. The number of partitions is given, as
    adaptive execution would otherwise merge the tiny rows into one task.
    """
    kind = requests.schema["request"].dataType.simpleString()
    return _by_cell(requests, segment).mapInArrow(
        _sieve_cells(False), f"request {kind}, prime long")


def primes_of_ranges(requests: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``prime``: those in any of the ranges, each once, without a shuffle of primes."""
    return _by_cell(requests, segment).mapInArrow(_sieve_cells(True), "prime long")


def primes_between(spark: SparkSession, start: int, end: int,
                   segment: int = SEGMENT) -> DataFrame:
    """The primes in ``[start, end]``, without any shuffle."""
    count = max(0, -(-(end - start + 1) // segment))
    parts = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    lo = F.lit(start).cast("long") + F.col("id") * F.lit(segment).cast("long")
    segments = spark.range(0, count, 1, parts).select(
        F.lit(0).alias("request"), lo.alias("lo"),
        F.least(lo + (segment - 1), F.lit(end).cast("long")).alias("hi"))
    return segments.mapInArrow(_sieve_batches, "request int, prime long").select("prime")
