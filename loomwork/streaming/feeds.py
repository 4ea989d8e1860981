"""Feeds that arrive in batches, and the results kept up to date over them.

The distinct set and the last-writer table keep one state row per key for as
long as the stream runs, since neither has a point after which a key is final.
Use the RocksDB state store for many keys. ``distinct_numbers`` takes an optional
watermark for callers who can bound how late a repeat may come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomwork.session import scratch_path

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch writes its changes; whole states are written in the background
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def batch_feed(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet",
               files_per_batch: int = 1, pattern: str | None = None,
               options: dict[str, str] | None = None) -> DataFrame:
    """A folder of files as a stream, so many files per batch.

    The batch bound is per file: split the input into files of the wanted size.
    Spark lists ahead while a batch runs, and ``run_to_end`` stops after the last.
    """
    reader = (spark.readStream.format(fmt).schema(schema)
              .option("maxFilesPerTrigger", files_per_batch).options(**(options or {})))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None],
               mode: str = "append", checkpoint: str | None = None,
               timeout: int | None = None) -> StreamingQuery:
    """Feed every batch there is now to ``sink(batch, batch_id)``, then stop."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream")
    query = (stream.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError("the stream did not reach its end in time")
    return query


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Every batch into a folder of its own, so that a batch run twice lands once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def progress_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One row per batch with its number of records."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.agg(F.count(F.lit(1)).alias("records"))
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))

    return write


def latest_by_key_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Batches of an update-mode stream: changed keys, one folder per batch."""
    return append_sink(path)


def collected(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What an append sink has written so far, with the batch number as ``batch``."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path)


def current_of_updates(updates: DataFrame, key: str) -> DataFrame:
    """The newest row of every key out of an update-mode sink's batches."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("row")
    return updates.groupBy(key).agg(newest).select(key, *[f"row.{c}" for c in rest])


def distinct_numbers(stream: DataFrame, column: str, event_time: str | None = None,
                     keep_for: str | None = None) -> DataFrame:
    """Every number the first time it is seen."""
    if event_time and keep_for:
        return (stream.withWatermark(event_time, keep_for)
                .dropDuplicatesWithinWatermark([column]))
    return stream.select(column).dropDuplicates([column])


def running_max(stream: DataFrame, column: str, default: int = 0) -> DataFrame:
    """The largest number so far, for complete mode; ``default`` before any."""
    return stream.agg(F.coalesce(F.max(column), F.lit(default)).alias("max_value"))


def last_writer_stream(stream: DataFrame, key: str, value: str, counter: str,
                       identifier: str) -> DataFrame:
    """Per key the version with the largest ``(counter, identifier)``, for update mode."""
    from loomwork.plans.lastwriter import latest_versions

    return latest_versions(stream, key, value, counter, identifier)
