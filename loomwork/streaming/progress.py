"""What every batch of a stream held, as a table written while the stream runs."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

NAME = "batch_progress"
ROWS, SECONDS = 512, 5.0  # of a file of progress rows


class ProgressTable(StreamingQueryListener):
    """Listens to streams made by ``observed`` and keeps one row per batch.

    A row is ``batch``, the observed metrics and ``nr``, which grows with every row; of a
    batch that is run again after a restart the last row counts. Rows are written together,
    a file per ``ROWS`` rows or ``SECONDS`` and at the end of a stream, so that the listener
    keeps up with short batches. Batches without records of streams that are through have
    no row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = {}
        self._rows: list[dict] = []
        self._written = self._heard = time.monotonic()

    def _end(self, run: object) -> threading.Event:
        return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = (event.progress.observedMetrics or {}).get(NAME)
        if found is not None and found.asDict().get("records"):
            row = {"batch": event.progress.batchId, "nr": time.time_ns(), **found.asDict()}
            if self._rows and row.keys() != self._rows[0].keys():
                self._write()
            self._rows.append(row)
            if len(self._rows) >= ROWS or time.monotonic() - self._written >= SECONDS:
                self._write()
        self._heard = time.monotonic()

    def onQueryTerminated(self, event) -> None:
        self._write()
        self._end(event.runId).set()

    def _write(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, ", ".join(f"{k} long" for k in rows[0])).coalesce(
                1).write.mode("append").parquet(self.path)
        self._written = self._heard = time.monotonic()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all events of a stream that was stopped have arrived.

        They may take as long as they need; ``seconds`` without any is an error.
        """
        self._heard = time.monotonic()
        while not self._end(query.runId).wait(max(0.01, self._heard + seconds - time.monotonic())):
            if time.monotonic() - self._heard >= seconds:
                raise TimeoutError("the end of the stream was not reported in time")


def observed(stream: DataFrame, **metrics: Column) -> DataFrame:
    """The stream, counting ``records`` and other whole-number aggregates per batch."""
    return stream.observe(NAME, F.count(F.lit(1)).alias("records"), *[
        m.cast("long").alias(name) for name, m in metrics.items()])


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all batches so far, and ``batch``."""
    found = spark.read.parquet(path)
    metrics = [c for c in found.columns if c not in ("batch", "nr")]
    return found.groupBy("batch").agg(
        F.max_by(F.struct(*metrics), "nr").alias("row")).select("row.*", "batch")
