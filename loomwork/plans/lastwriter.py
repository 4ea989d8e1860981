"""Last-writer-wins merge of versioned values.

A version is ``(value, counter, identifier)``. Of two versions of a key the one
with the larger counter wins, on equal counters the one with the larger
identifier; an exact repeat changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(versions: DataFrame, key: str, value: str, counter: str,
                    identifier: str) -> DataFrame:
    """The winning version of every key.

    The ordering key includes the value, so the result does not depend on row
    order even if two versions carry the same counter and identifier. Each task
    keeps one version per key before the shuffle, however often a key occurs.
    """
    winner = F.max(F.struct(
        F.col(counter).alias("counter"), F.col(identifier).alias("identifier"),
        F.col(value).alias("value"))).alias("version")
    return (
        versions.where(F.col(counter).isNotNull())
        .groupBy(F.col(key).alias("key")).agg(winner)
        .select("key", "version.value", "version.counter", "version.identifier")
    )


def merge_replicas(*replicas: DataFrame) -> DataFrame:
    """Replicas ``(key, value, counter, identifier)`` merged into one."""
    merged = replicas[0]
    for other in replicas[1:]:
        merged = merged.unionByName(other)
    return latest_versions(merged, "key", "value", "counter", "identifier")


def apply_writes(state: DataFrame, writes: DataFrame) -> DataFrame:
    """The state after a batch of concurrent writes.

    Both tables are ``(key, value, counter, identifier)``; a write carries the
    counter its writer last read. The best write of a key is accepted if the key
    is new, or its stored version is older, or equally old with a smaller
    identifier; it is stored under its counter + 1. Other writes are dropped
    silently, as are keys' losing writes.
    """
    best = latest_versions(writes, "key", "value", "counter", "identifier")
    old = F.struct(F.col("s.counter"), F.col("s.identifier"))
    new = F.struct(F.col("w.counter"), F.col("w.identifier"))
    joined = state.alias("s").join(best.alias("w"), F.col("s.key") == F.col("w.key"), "full_outer")
    accept = F.col("w.key").isNotNull() & (F.col("s.key").isNull() | (old < new))
    return joined.select(
        F.coalesce("s.key", "w.key").alias("key"),
        F.when(accept, F.col("w.value")).otherwise(F.col("s.value")).alias("value"),
        F.when(accept, F.col("w.counter") + 1).otherwise(F.col("s.counter")).alias("counter"),
        F.when(accept, F.col("w.identifier")).otherwise(F.col("s.identifier"))
        .alias("identifier"),
    )


def read_keys(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored versions of the asked keys; an absent key gives no row."""
    return state.join(keys.select("key").distinct(), "key", "left_semi")
