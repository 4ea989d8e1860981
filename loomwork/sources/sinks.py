"""Sinks, views and printing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession


def register(df: DataFrame, name: str) -> DataFrame:
    """Make the table visible to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def take(df: DataFrame, n: int) -> list[Row]:
    """``n`` rows on the driver."""
    return df.take(n)


def collect_report(df: DataFrame, max_rows: int = 10_000) -> list[Row]:
    """All rows of a report on the driver; a larger table is an error, not a cut."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: write the table instead")
    return rows


def for_each_row(df: DataFrame, action: Callable[[Row], None]) -> None:
    """Run a side effect for every row on the executors."""

    def run(rows: Iterable[Row]) -> None:
        for row in rows:
            action(row)

    df.foreachPartition(run)


def print_schema(df: DataFrame) -> None:
    df.printSchema()


def print_plan(df: DataFrame, mode: str = "formatted") -> None:
    df.explain(mode)


class ResultCollector:
    """Appends result tables to one parquet folder and reads all of them back."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
