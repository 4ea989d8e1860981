"""Tables made from literals and number ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def from_rows(spark: SparkSession, rows: Sequence, schema: StructType | str) -> DataFrame:
    """A small in-memory table; scalars become one-column rows."""
    rows = [r if isinstance(r, (tuple, list, dict)) else (r,) for r in rows]
    return spark.createDataFrame(rows, schema)


def number_range(spark: SparkSession, start: int, end: int,
                 partitions: int | None = None, name: str = "value") -> DataFrame:
    """The whole numbers ``start`` to ``end`` inclusive; empty if ``start > end``."""
    df = spark.range(start, max(end + 1, start), 1, partitions)
    return df.withColumnRenamed("id", name)
