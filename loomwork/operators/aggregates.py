"""Aggregates and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.session import materialize


def joined_text(df: DataFrame, value: str, by: Sequence[str], sep: str = ",",
                name: str = "joined") -> DataFrame:
    """The distinct values of every group, sorted and joined with ``sep``.

    For groups whose number of *distinct* values is small by nature (categories,
    attribute names): repeated values collapse before the shuffle. A whole
    column of many values goes through ``joined_text_pieces``.
    """
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(name))
    )


def joined_text_pieces(df: DataFrame, value: str, sep: str = ",",
                       size: int = 1 << 20) -> DataFrame:
    """All values of a column, repeats kept, sorted and joined, as pieces of ``size`` characters.

    ``piece, at, joined``: the text of the reduction is the pieces in order, each ``size``
    characters long but the last; ``at`` is the piece's offset. Reducing a column to
    one string would put the whole column into one row. Here every distinct value gets
    the place at which its repeats begin, by running sums within ranges of values and over
    ranges, and every piece is put together from the values that reach into it. A value
    that fills a third of the column is one row until then, and a long one is cut.
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("v"))
        .agg(F.count(F.lit(1)).alias("n")))
    step = F.length("v").cast("long") + len(sep)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counted.repartitionByRange(parts, "v").select(
        F.spark_partition_id().alias("part"), "v", "n", (F.col("n") * step).alias("chars")), "values")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = ranged.groupBy("part").agg(F.sum("chars").alias("chars"), F.lit(1).alias("one")).select(
        "part", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"),
        F.sum("chars").over(Window.partitionBy("one")).alias("total"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("first", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(
        bases, "part").select(
        "v", (F.col("base") + F.col("first")).alias("first"), "chars",
        (F.col("total") - len(sep)).alias("end"))  # nothing after the last value
    width = F.lit(size).cast("long")
    piece = F.explode(F.sequence(
        F.call_function("div", F.col("first"), width),
        F.call_function("div", F.greatest(
            F.least(F.col("first") + F.col("chars"), F.col("end")) - 1, F.col("first")), width)))
    reached = placed.select("*", piece.alias("piece"))
    # the part of a value's repeats inside a piece: from a phase of one repeat, so many characters
    a = F.greatest(F.col("first"), F.col("piece") * width)
    b = F.least(F.col("first") + F.col("chars"), (F.col("piece") + 1) * width, F.col("end"))
    cut = reached.where(b > a).select(
        "piece", a.alias("a"), (b - a).cast("int").alias("len"),
        F.concat("v", F.lit(sep)).alias("unit"), ((a - F.col("first")) % step).cast("int").alias(
            "phase"))
    times = F.ceil((F.col("phase") + F.col("len")) / F.length("unit")).cast("int")
    text = F.substring(F.repeat("unit", times), F.col("phase") + 1, F.col("len"))
    return cut.select("piece", "a", text.alias("text")).groupBy("piece").agg(
        F.min("a").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "text"))),
                                 lambda r: r["text"]), "").alias("joined"))


def number_list_pieces(df: DataFrame, number: str, width: int = 100_000,
                       sep: str = ";") -> DataFrame:
    """The sorted distinct numbers as joined text, one piece per ``width`` of value.

    A piece holds at most ``width`` numbers by construction.
    """
    n = F.col(number).cast("long")
    return (
        df.select(n.alias("n")).where(F.col("n").isNotNull())
        .groupBy(F.floor(F.col("n") / F.lit(width)).cast("long").alias("piece"))
        .agg(F.collect_set("n").alias("ns"))
        .select("piece", F.size("ns").alias("items"),
                F.array_join(F.transform(F.array_sort("ns"), lambda x: x.cast("string")), sep)
                .alias("joined"))
    )


def top_per_group(df: DataFrame, group: str, value: str, tie: str,
                  keep: Sequence[str] = ()) -> DataFrame:
    """The row with the largest value of each group; ties go to the smallest ``tie``.

    ``value`` may have any type that Spark orders; NaN is the largest number and a
    null value never wins over another. Every task keeps one candidate per group
    before the shuffle.
    """
    cols = [c for c in dict.fromkeys([tie, value, *keep]) if c != group]
    return top_per_group_window(df.select(group, *cols), group, value, tie)


def top_per_group_window(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The same as a window; Spark limits each group map-side before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(value), F.asc(tie))
    return (df.withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") == 1).drop("__rn"))


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One count per condition, all in one pass."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def observe_counts(df: DataFrame, conditions: Mapping[str, Column],
                   name: str = "counts") -> tuple[DataFrame, Observation]:
    """Count as a side effect of whatever action runs on the returned table.

    Read ``observation.get`` after the action.
    """
    observation = Observation(name)
    metrics = [F.count_if(cond).alias(k) for k, cond in conditions.items()]
    return df.observe(observation, *metrics), observation


def max_or(df: DataFrame, column: str, default=0, name: str = "max_value") -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(default)).alias(name))


def sum_where(df: DataFrame, column: str, predicate: Column, name: str = "total") -> DataFrame:
    """Sum of the numbers that pass the predicate; 0 where none does."""
    return df.where(predicate).agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))


def all_parts_complete(parts: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, whether every part has a non-empty value."""
    done = F.coalesce((F.col(value).isNotNull()) & (F.col(value) != ""), F.lit(False))
    return parts.groupBy(key).agg(F.bool_and(done).alias("complete"),
                                  F.count(F.lit(1)).alias("parts"))


def attribute_sets(cells: DataFrame) -> DataFrame:
    """``(value, attributes)``: the attributes every value occurs in, sorted.

    An array has at most one entry per attribute of the schema.
    """
    return cells.groupBy("value").agg(
        F.array_sort(F.collect_set("attribute")).alias("attributes"))


def group_sets(df: DataFrame, key: str, array_column: str, name: str = "sets") -> DataFrame:
    """The distinct arrays of every key, for keys with few distinct arrays."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(array_column)).alias(name))


def accuracy(predictions: DataFrame, label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    hit = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    return predictions.agg(hit.alias("accuracy"), (F.lit(1.0) - hit).alias("test_error"))
