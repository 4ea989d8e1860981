"""Which characters of an entity's alphabet survive all its hints.

An entity has an alphabet, a digest, and an array of hint digests. A hint is a
text that lacks characters which the entity's value does not contain. Hints and
values are known by digest only and looked up in a caller-supplied table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import characters
from loomwork.operators.joins import digest_join


def hint_rows(entities: DataFrame) -> DataFrame:
    """``(id, hint_no, digest)``, one row per hint of ``(id, …, hints)``."""
    return entities.select("id", F.posexplode("hints").alias("hint_no", "digest"))


def solve_hints(entities: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """``(id, hint_no, digest, value)`` with null where the digest is not known."""
    found = digest_join(hint_rows(entities), "digest", values, value, how="left")
    return found.select("id", "hint_no", "digest", F.col(value).alias("value"))


def eliminate(entities: DataFrame, solved: DataFrame) -> DataFrame:
    """``(id, remaining, solved_hints, complete)`` per entity.

    ``remaining`` keeps the alphabet's order. The group's state is the set of
    removed characters, which is never larger than the alphabet, whatever the
    number of hint rows.
    """
    has_value = F.col("value").isNotNull() & (F.col("value") != "")
    lacking = F.when(has_value, F.array_except(
        characters(F.col("alphabet")), characters(F.col("value"))))
    # one join by id, whose partitioning also serves the aggregate
    per_hint = entities.select("id", "alphabet").join(
        solved.select("id", "hint_no", "value"), "id", "left"
    ).select("id", "alphabet", F.col("hint_no").isNotNull().alias("hint"),
             (F.col("hint_no").isNotNull() & has_value).alias("solved"),
             F.posexplode_outer(lacking).alias("nth", "ch"))
    first = F.col("nth").isNull() | (F.col("nth") == 0)  # one row of each hint
    progress = per_hint.groupBy("id", "alphabet").agg(
        F.count_if(first & F.col("hint")).alias("hints"),
        F.count_if(first & F.col("solved")).alias("solved_hints"),
        F.collect_set("ch").alias("removed"))
    return progress.select(
        "id",
        F.array_join(F.array_except(characters(F.col("alphabet")), F.col("removed")), "")
        .alias("remaining"),
        "solved_hints",
        ((F.col("hints") > 0) & (F.col("hints") == F.col("solved_hints"))).alias("complete"))


def resolve_entities(entities: DataFrame, hint_values: DataFrame, values: DataFrame,
                     value: str = "value") -> DataFrame:
    """The whole record pipeline: hints, elimination, value lookup, attach.

    ``(id, remaining, solved_hints, complete, resolved)``. A value is attached
    only to entities whose hints are all solved and to which its characters are
    still open; ``resolved`` is null otherwise.
    """
    progress = eliminate(entities, solve_hints(entities, hint_values))
    found = digest_join(entities.select("id", "digest"), "digest", values, value, how="left")
    open_chars = F.size(F.array_except(
        characters(F.col(value)), characters(F.col("remaining")))) == 0
    return progress.join(found.select("id", value), "id", "left").select(
        "id", "remaining", "solved_hints", "complete",
        F.when(F.col("complete") & open_chars & (F.col(value) != ""), F.col(value))
        .alias("resolved"))
