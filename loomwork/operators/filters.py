"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_list(df: DataFrame, column: str, items: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(items)))


def not_in_list(df: DataFrame, column: str, items: Sequence) -> DataFrame:
    """Rows whose value is not in the list; a null value is not in any list."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(items)))


def equals_item(df: DataFrame, column: str, items: Sequence, index: int) -> DataFrame:
    return df.where(F.col(column) == F.lit(items[index]))


def non_empty(df: DataFrame, array_column: str) -> DataFrame:
    return df.where(F.size(array_column) > 0)


def without_own(df: DataFrame, key: str, array_column: str) -> DataFrame:
    """Drop the row's own key from its array."""
    return df.withColumn(array_column, F.array_remove(F.col(array_column), F.col(key)))
