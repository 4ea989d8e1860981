"""Projections and retyping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename every column by position."""
    return df.toDF(*names)


def with_literals(df: DataFrame, key: str, **literals) -> DataFrame:
    """``key`` next to constant columns."""
    return df.select(key, *[F.lit(v).alias(k) for k, v in literals.items()])


def retype(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns, keep the others."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def single_columns(df: DataFrame) -> list[DataFrame]:
    """One single-column table per attribute (plans over the same pruned scan)."""
    return [df.select(c) for c in df.columns]


def unpivot_cells(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All non-null cells of all tables as ``(value, attribute)``.

    Every table is scanned once; attributes are named ``table.column`` so that
    equal column names of two tables stay apart.
    """
    parts = []
    for table, df in tables.items():
        stacked = ", ".join(
            f"'{table}.{c}', cast(`{c}` as string)" for c in df.columns
        )
        parts.append(
            df.selectExpr(f"stack({len(df.columns)}, {stacked}) as (attribute, value)")
            .where(F.col("value").isNotNull())
            .select("value", "attribute")
        )
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells


def tail_to_array(df: DataFrame, heads: Mapping[str, Column | str],
                  tail: Sequence[str], array_name: str) -> DataFrame:
    """A positional record as named fields plus an array of its tail fields."""
    named = [(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in heads.items()]
    return df.select(*named, F.array(*[F.col(c) for c in tail]).alias(array_name))


def fill_nulls(df: DataFrame, value, columns: Sequence[str]) -> DataFrame:
    """Fill nulls of the named columns; columns of another type stay as they are."""
    return df.na.fill(value, subset=list(columns))


def numbered(ranges: DataFrame, first: str, last: str, name: str,
             deal: Sequence[str] = ()) -> DataFrame:
    """A row per whole number ``name`` from column ``first`` to column ``last``.

    In two levels, so that no row or task holds a whole range: as many blocks as a
    block has numbers, dealt out by the ``deal`` columns and block, then the numbers of
    each block.
    """
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, end = F.col("__w"), F.col(last)
    blocks = (
        ranges.withColumn("__w", F.ceil(F.sqrt(end - F.col(first) + 1)).cast("long"))
        .withColumn("__block", F.explode(F.sequence(F.col(first), end, width)))
        .repartition(tasks, *deal, "__block"))
    return blocks.withColumn(name, F.explode(F.sequence(
        "__block", F.least(F.col("__block") + width - 1, end)))).drop("__w", "__block")
