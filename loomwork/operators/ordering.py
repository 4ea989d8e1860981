"""Sorting and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by(df: DataFrame, *columns: str) -> DataFrame:
    """Sort by explicit keys; without any, by all columns from left to right."""
    return df.orderBy(*(columns or df.columns))


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(column), *[F.asc(t) for t in ties])


def top_k(df: DataFrame, k: int, column: str, *ties: str) -> DataFrame:
    """The ``k`` rows with the largest ``column``; ``ties`` make the order total.

    Spark runs this as a per-task top-k and one small merge.
    """
    return sort_desc(df, column, *ties).limit(k)


def first_n(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)
