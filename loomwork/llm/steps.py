"""Steps of long jobs: written to the shared folder, in batches that fit a worker."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loomwork import session

#: Arrow batches of few rows and bytes, as rows may hold whole texts; and shuffle files
#: go with the job that wrote them, since its result is written and nothing reads them.
STEP = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in STEP}
    for k, v in STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for the session, for results that hold Python steps."""
    for k in [k for k in STEP if ".arrow." in k]:
        spark.conf.set(k, STEP[k])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the end of a step."""
    with _settings(df.sparkSession):
        return session.materialize(df, tag)
