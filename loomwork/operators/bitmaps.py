"""Bit sets over whole numbers, as runs of 64-bit words.

A row ``(word, n, bits)`` says that each of the ``n`` words from ``word`` on holds ``bits``.
Scattered positions are single words, a range of any length is one run of full words with
a word at either end, and words that are not there are empty. Words are combined by
``bit_or`` and ``bit_and``, which Spark's hash aggregate does inside each task before
anything moves. The rows of a set are disjoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.projections import numbered

WORD = 64
CHUNK_BITS = 20  # ranges are put together within so many positions, a power of two


def word_of(position: Column) -> Column:
    return F.shiftright(position.cast("long"), 6)


def _at(position: Column) -> Column:
    return position.cast("long").bitwiseAND(F.lit(WORD - 1).cast("long")).cast("int")


def _left(value: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), by)


def _words(bitmaps: DataFrame) -> DataFrame:
    """The words one by one; a run is no longer than a chunk."""
    last = F.col("word") + F.col("n") - 1
    return bitmaps.withColumn("word", F.explode(F.sequence("word", last))).withColumn(
        "n", F.lit(1).cast("long"))


def bitmap_build(df: DataFrame, position: str, by: Sequence[str] = ()) -> DataFrame:
    """The set of a column's values, one for each group."""
    p = F.col(position)
    return df.where(p.isNotNull()).groupBy(*by, word_of(p).alias("word")).agg(
        F.bit_or(_left(1, _at(p))).alias("bits")).select(
        *by, "word", F.lit(1).cast("long").alias("n"), "bits")


def bitmap_union(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _words(bitmaps).groupBy(*by, "word").agg(F.bit_or("bits").alias("bits")).select(
        *by, "word", F.lit(1).cast("long").alias("n"), "bits")


def bitmap_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersection of two bit sets; a word one side lacks is empty."""
    zero = F.lit(0).cast("long")
    both = _words(left).select("word", "bits", zero.alias("other")).unionAll(
        _words(right).select("word", zero.alias("bits"), F.col("bits").alias("other")))
    common = F.bit_or("bits").bitwiseAND(F.bit_or("other"))
    return both.groupBy("word").agg(common.alias("bits")).where("bits <> 0").select(
        "word", F.lit(1).cast("long").alias("n"), "bits")


def bitmap_cardinality(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = F.coalesce(F.sum(F.bit_count("bits") * F.col("n")), F.lit(0))
    return bitmaps.groupBy(*by).agg(n.alias("cardinality"), (n == 0).alias("is_empty"))


def bitmap_positions(bitmaps: DataFrame) -> DataFrame:
    """The set positions again, as rows; at most 64 per word."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1)
    return _words(bitmaps).select("word", F.explode(bits).alias("bit")).select(
        (F.col("word") * WORD + F.col("bit")).alias("position"))


def bitmap_contains(df: DataFrame, column: str, bitmaps: DataFrame) -> DataFrame:
    """``df`` with a boolean ``member``: is the value in the bit set.

    Joins on the word, of which there is one row each, and reads one bit.
    """
    member = F.coalesce(F.getbit("__bits", _at(F.col(column))) == 1, F.lit(False))
    words = _words(bitmaps).select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    return df.join(words, word_of(F.col(column)) == F.col("__word"), "left").withColumn(
        "member", member).drop("__word", "__bits")


def logical_length(df: DataFrame, position: str) -> DataFrame:
    """Highest position + 1, or 0 for the empty set."""
    return df.agg(F.coalesce(F.max(F.col(position).cast("long")) + 1, F.lit(0).cast("long"))
                  .alias("length"))


def _merged(ranges: DataFrame, low: str, high: str, by: Sequence[str]) -> DataFrame:
    """``__chunk, lo, hi``: the ranges of a group put together, cut at chunk borders.

    Of ranges with the same start the longest is kept inside each task, so a chunk
    has no more rows than positions, however many ranges meet there.
    """
    lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
    spans = ranges.where(lo < hi).select(
        *by, lo.alias("__lo"), hi.alias("__hi"), F.shiftright(lo, CHUNK_BITS).alias("__first"),
        F.shiftright(hi - 1, CHUNK_BITS).alias("__last"))
    start = F.call_function("shiftleft", F.col("__chunk"), F.lit(CHUNK_BITS))
    pieces = numbered(spans, "__first", "__last", "__chunk", [*by, "__lo"]).select(
        *by, "__chunk", F.greatest(F.col("__lo"), start).alias("lo"),
        F.least(F.col("__hi"), start + (1 << CHUNK_BITS)).alias("hi"))
    longest = pieces.groupBy(*by, "__chunk", "lo").agg(F.max("hi").alias("hi"))
    line = Window.partitionBy(*by, "__chunk").orderBy("lo")
    reach = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = longest.withColumn("__new", (reach.isNull() | (F.col("lo") > reach)).cast("int"))
    islands = apart.withColumn("__island", F.sum("__new").over(line))
    return islands.groupBy(*by, "__chunk", "__island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bitmap_from_ranges(ranges: DataFrame, low: str, high: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """The set of all positions in the half-open ranges ``[low, high)``.

    Overlapping ranges are put together first; what is left is at most three rows
    for each of them and chunk: a run of full words and the words at its ends.
    """
    first, last = word_of(F.col("lo")), word_of(F.col("hi") - 1)
    from_low = _left(-1, _at(F.col("lo")))
    to_high = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"),
                              F.lit(WORD - 1) - _at(F.col("hi") - 1))
    one = F.lit(1).cast("long")

    def run(word: Column, n: Column, bits: Column) -> Column:
        return F.struct(word.alias("word"), n.alias("n"), bits.alias("bits"))

    several = F.array(run(first, one, from_low), run(first + 1, last - first - 1, F.lit(-1).cast("long")),
                      run(last, one, to_high))
    single = F.array(run(first, one, from_low.bitwiseAND(to_high)))
    rows = _merged(ranges, low, high, by).select(*by, F.explode(F.when(
        first == last, single).otherwise(several)).alias("run")).select(*by, "run.*").where("n > 0")
    # two ranges may end and begin in the same word
    return rows.groupBy(*by, "word", "n").agg(F.bit_or("bits").alias("bits"))
