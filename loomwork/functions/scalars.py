"""Column functions. Every one is a built-in Spark expression."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "add_days", "all_distinct_chars", "bit_clear", "bit_flip", "bit_get", "bit_set",
    "characters", "contains_text", "digest_matches", "hash_bucket", "in_range",
    "inclusion_line", "intersect_all", "leave_one_out",
    "prefixed", "register_twice_plus_half", "says", "sha256_hex", "slice_text",
    "text_to_int", "twice_plus_half", "typed_null",
]


def prefixed(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), col.cast("string"))


def says(col: Column, phrase: str) -> Column:
    """``"<value> <phrase>"``, e.g. a record's name with a greeting appended."""
    return F.concat(col.cast("string"), F.lit(" " + phrase))


def contains_text(col: Column, piece: str) -> Column:
    return col.contains(piece)


def twice_plus_half(col: Column) -> Column:
    return col.cast("int") * F.lit(2) + F.lit(0.5)


def register_twice_plus_half(spark: SparkSession, name: str = "twice_plus_half") -> str:
    """The same arithmetic as a SQL function, which Catalyst inlines."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(i INT) RETURNS DOUBLE "
        "RETURN i * 2 + 0.5D"
    )
    return name


def typed_null(sql_type: str = "string") -> Column:
    return F.lit(None).cast(sql_type)


def add_days(col: Column, days: int) -> Column:
    return F.date_add(col, days)


def characters(col: Column) -> Column:
    """The characters of a string in order; an empty string gives an empty array."""
    return F.filter(F.split(col, ""), lambda c: c != "")


def all_distinct_chars(col: Column) -> Column:
    return F.array_sort(F.array_distinct(characters(col)))


def slice_text(col: Column, start: Column | int, end: Column | int) -> Column:
    """Characters ``start`` (0-based, inclusive) to ``end`` (exclusive)."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    return F.substring(col, start + 1, end - start)


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("string").cast("binary"), 256)


def digest_matches(col: Column, digest: Column) -> Column:
    return sha256_hex(col) == digest


def hash_bucket(col: Column, buckets: int) -> Column:
    """A bucket number in ``[0, buckets)``."""
    return F.pmod(F.xxhash64(col), F.lit(buckets).cast("long"))


def _bit(position: Column | int) -> Column:
    """``1 << position``; Spark's shift function takes only literal widths."""
    position = F.lit(position) if isinstance(position, int) else position
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def bit_get(mask: Column, position: Column | int) -> Column:
    position = F.lit(position) if isinstance(position, int) else position
    return F.getbit(mask.cast("long"), position.cast("int")) == 1


def bit_set(mask: Column, position: Column | int) -> Column:
    return mask.bitwiseOR(_bit(position))


def bit_clear(mask: Column, position: Column | int) -> Column:
    return mask.bitwiseAND(F.bitwise_not(_bit(position)))


def bit_flip(mask: Column, position: Column | int) -> Column:
    return mask.bitwiseXOR(_bit(position))


def in_range(col: Column, low: int | Column, high: int | Column) -> Column:
    """``low <= col <= high``, both ends included."""
    return col.between(low, high)


def text_to_int(col: Column) -> Column:
    """The text as a whole number, or null where it is not one."""
    return col.try_cast("bigint")


def leave_one_out(alphabet: Column) -> Column:
    """For every item of the array, the array without that item."""
    return F.transform(alphabet, lambda c: F.array_remove(alphabet, c))


def intersect_all(arrays: Column) -> Column:
    """Items common to all arrays of an array of arrays, in the first one's order."""
    return F.aggregate(
        F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))),
        F.element_at(arrays, 1),
        lambda acc, nxt: F.array_intersect(acc, nxt),
    )


def inclusion_line(dependent: Column, referenced: Column) -> Column:
    return F.concat(dependent, F.lit(" < "), F.array_join(referenced, ", "))
