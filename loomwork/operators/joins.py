"""Lookups and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from loomwork.functions import sha256_hex
from loomwork.operators import bloom
from loomwork.session import materialize


def _names(names: DataFrame, column: str, max_rows: int | None) -> DataFrame:
    keys = names.toDF(column)
    if max_rows is None:
        return keys
    return F.broadcast(keys) if keys.limit(max_rows + 1).count() <= max_rows else keys


def list_semi(df: DataFrame, names: DataFrame, column: str,
              max_rows: int | None = None) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column table ``names``.

    Whether ``names`` is broadcast is left to its size in bytes: Spark's own
    threshold, or the adaptive plan once the size is known. A caller who knows that
    its rows are short may name ``max_rows`` up to which it is marked for broadcast,
    which counts them first.
    """
    return df.join(_names(names, column, max_rows), column, "left_semi")


def list_anti(df: DataFrame, names: DataFrame, column: str,
              max_rows: int | None = None) -> DataFrame:
    """Rows whose ``column`` does not occur in ``names``; null rows are kept."""
    return df.join(_names(names, column, max_rows), column, "left_anti")


def summarize_others(df: DataFrame, key: str, value: str) -> DataFrame:
    """For every key, an aggregate over the rows of all *other* keys.

    This is the self join on ``a.key <> b.key`` followed by a group-by on
    ``a.key``, without the pairs: counts and sums of the others are the total
    less the own part, the largest value of the others is the table's largest
    unless that is one's own, then the largest of the second-best key. Per-key
    partial sums combine before the shuffle, so a key holding a third of the
    rows costs no more than any other. Keys that occur alone give no row.

    Taking one's own part off a total of floating numbers would cancel, so theirs are
    summed from the keys before and the keys after; a NaN counts for others only.
    """
    floating = df.schema[value].dataType.typeName() in ("double", "float")
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("own_rows"),
        F.count(value).alias("own_values"),
        F.sum(value).alias("own_sum"),
        F.max(value).alias("own_max"),
    )
    if floating:
        per_key = _with_sum_of_others(per_key, key)
    totals = per_key.agg(F.struct(
        F.sum("own_rows").alias("rows"), F.sum("own_values").alias("values"),
        F.sum("own_sum").alias("sum"))).scalar()
    # the two largest per-key maxima: the second equals the first on a tie
    top_two = (
        per_key.select("own_max").orderBy(F.desc_nulls_last("own_max")).limit(2)
        .agg(F.sort_array(F.collect_list("own_max"), asc=False)).scalar()
    )
    return (
        per_key.withColumns({"all": totals, "top": top_two})
        .where(F.col("all.rows") > F.col("own_rows"))
        .select(
            key,
            (F.col("all.rows") - F.col("own_rows")).alias("other_rows"),
            F.when(F.col("all.values") > F.col("own_values"),
                   F.col("others") if floating else
                   F.col("all.sum") - F.coalesce("own_sum", F.lit(0))).alias("other_sum"),
            F.when(F.col("own_max") == F.try_element_at("top", F.lit(1)),
                   F.try_element_at("top", F.lit(2)))
            .otherwise(F.try_element_at("top", F.lit(1))).alias("other_max"),
        )
    )


def _with_sum_of_others(per_key: DataFrame, key: str) -> DataFrame:
    """Adds ``others``, the sum of ``own_sum`` over all other rows, without subtraction.

    Running sums from both ends within ranges of keys, and over the ranges, of which
    there are as many as shuffle partitions.
    """
    parts = int(per_key.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(per_key.repartitionByRange(parts, key).withColumn(
        "part", F.spark_partition_id()), "keys")

    def around(column: str, line: WindowSpec) -> Column:
        before = F.sum(column).over(line.rowsBetween(Window.unboundedPreceding, -1))
        after = F.sum(column).over(line.rowsBetween(1, Window.unboundedFollowing))
        zero = F.lit(0.0)
        return F.coalesce(before, zero) + F.coalesce(after, zero)

    whole = ranged.groupBy("part").agg(F.sum("own_sum").alias("sum")).select(
        "part", around("sum", Window.orderBy("part")).alias("far"))
    near = around("own_sum", Window.partitionBy("part").orderBy(key)).alias("near")
    return ranged.select("*", near).join(whole, "part").withColumn(
        "others", F.col("near") + F.col("far")).drop("part", "near", "far")


def digest_join(digests: DataFrame, digest: str, values: DataFrame, value: str,
                how: str = "inner") -> DataFrame:
    """Match stored SHA-256 digests against a caller-supplied table of values.

    An equi-join on the digest. The values are made distinct first, so that a
    repeated value never repeats a digest row; a digest shared by very many rows
    meets exactly one value row, which the adaptive skew join may split freely.
    """
    known = values.select(F.col(value)).where(F.col(value).isNotNull()).distinct()
    keyed = known.withColumn("__digest", sha256_hex(F.col(value)))
    return digests.join(keyed, F.col(digest) == F.col("__digest"), how).drop("__digest")


def attach(entities: DataFrame, solved: DataFrame, on: Sequence[str],
           value: str | None = None) -> DataFrame:
    """Attach solved values to their entities, keeping unsolved entities.

    With ``value`` given, empty and null solutions are skipped first.
    """
    if value is not None:
        solved = solved.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return entities.join(solved, list(on), "left")


def bitmap_prefilter(df: DataFrame, key: str, members: DataFrame, member: str,
                     bits: int = 1 << 14, position=None) -> DataFrame:
    """Rows of ``df`` whose hashed key position is set by ``members``.

    One hash, as a table of at most ``bits`` set positions: it passes every true member
    and some others, so follow it with the exact join.
    """
    position = position or (lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long")))
    marks = members.select(position(F.col(member)).alias("__pos")).distinct()
    return (
        df.withColumn("__pos", position(F.col(key)))
        .join(marks, "__pos", "left_semi")
        .drop("__pos")
    )


def bloom_semi_join(df: DataFrame, key: str, members: DataFrame, member: str,
                    rate: float = 0.01) -> DataFrame:
    """Exact semi-join behind a Bloom filter that thins the shuffled side."""
    built = bloom.build(members, member, rate)
    keys = members.select(F.col(member).alias(key)).distinct()
    return bloom.passing(df, key, built).join(keys, key, "left_semi")


def nested_field(record: str, field: str) -> Column:
    return F.col(f"{record}.{field}")
