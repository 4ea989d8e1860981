"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: str | None = None


def build_session(app: str = "loomwork", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution on and timestamps pinned to UTC.

    Leave ``master`` and ``shuffle_partitions`` unset on a cluster: the first
    comes from ``spark-submit`` and the second should be a multiple of the
    executor cores there, which adaptive execution then coalesces.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; a cluster without it is an error, since a machine-local folder would
    lose data with the machine.
    """
    global _local_scratch
    shared = spark.conf.get(SCRATCH_CONF, None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SCRATCH_CONF} to a folder all executors can reach")
    if _local_scratch is None or not os.path.isdir(_local_scratch):
        _local_scratch = tempfile.mkdtemp(prefix="loomwork-")
    return _local_scratch


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/loomwork/{tag}-{uuid.uuid4().hex}"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the job that wrote them, since its result is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage for iterative plans. The written table survives lost
    executors, is columnar, and gives the optimizer a real size for the next
    join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
