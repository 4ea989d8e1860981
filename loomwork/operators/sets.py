"""Set operations on tables and arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag_union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def distinct_union(tables: Sequence[DataFrame]) -> DataFrame:
    """Partial result lists as one set."""
    return bag_union(tables).distinct()


def _membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides with a flag per side; one shuffle, combined map-side."""
    tagged = left.select(F.col(key), F.lit(True).alias("l"), F.lit(False).alias("r")).unionAll(
        right.select(F.col(key), F.lit(False).alias("l"), F.lit(True).alias("r")))
    return tagged.groupBy(key).agg(F.bool_or("l").alias("in_left"),
                                   F.bool_or("r").alias("in_right"))


def set_algebra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per key of either side: is it in the AND, OR, XOR and AND-NOT of the two sets."""
    both, one = F.col("in_left") & F.col("in_right"), F.col("in_left") != F.col("in_right")
    return _membership(left, right, key).select(
        key, both.alias("in_and"), F.lit(True).alias("in_or"), one.alias("in_xor"),
        (F.col("in_left") & ~F.col("in_right")).alias("in_and_not"))


def set_and(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def set_or(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def set_xor(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return (_membership(left, right, key)
            .where(F.col("in_left") != F.col("in_right")).select(key))


def set_and_not(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def sets_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: do the two key sets share a key, and how many."""
    return _membership(left, right, key).agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("shared_keys")
    ).select((F.col("shared_keys") > 0).alias("overlap"), "shared_keys")


def array_common(left: Column, right: Column) -> Column:
    """Items of ``left`` that ``right`` has too, in the order of ``left``."""
    return F.array_intersect(left, right)


def arrays_share(left: Column, right: Column) -> Column:
    return F.arrays_overlap(left, right)
