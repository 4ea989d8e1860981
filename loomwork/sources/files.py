"""File and database scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomwork.sources.records import read_records

# A character no text file holds, so that only an absent field reads as null.
NEVER = "\u0001"


@dataclass(frozen=True)
class CsvDialect:
    """How a delimited file is written.

    ``empty_is_null`` keeps ``a;;b`` (null) and ``a;"";b`` (empty string) apart.
    ``skip_differing`` drops lines with too few or too many fields.
    ``strict_quotes`` keeps only what stands inside quotes: fields that are not
    quoted as a whole read as null.
    ``multi_line`` reads line breaks inside quotes as text. Large files are still read
    by many tasks; only without a schema is each file one task's work.
    """

    sep: str = ";"
    quote: str = '"'
    escape: str = "\\"
    header: bool = True
    strict_quotes: bool = False
    ignore_leading_blanks: bool = True
    empty_is_null: bool = True
    encoding: str = "UTF-8"
    skip_differing: bool = False
    multi_line: bool = False

    def options(self) -> dict[str, str]:
        return {
            "sep": self.sep, "quote": self.quote, "escape": self.escape,
            "header": str(self.header).lower(), "encoding": self.encoding,
            "ignoreLeadingWhiteSpace": str(self.ignore_leading_blanks).lower(),
            "nullValue": NEVER if self.empty_is_null else "",
            "emptyValue": "",
            "multiLine": str(self.multi_line).lower(),
            "mode": "DROPMALFORMED" if self.skip_differing else "PERMISSIVE",
        }


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             dialect: CsvDialect = CsvDialect()) -> DataFrame:
    """A delimited file. Without a schema the types are inferred, which costs a scan."""
    if dialect.strict_quotes:
        return _strict_quoted(spark, path, schema, dialect)
    reader = spark.read.options(**dialect.options())
    if dialect.multi_line and schema is not None:
        return _parsed(_records(spark, path, dialect), _typed(schema), dialect)
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    df = reader.schema(schema).csv(path)
    if dialect.skip_differing:
        # With columns pruned away Spark would parse, and so reject, fewer lines.
        df = df.sparkSession.read.options(**dialect.options()).option(
            "columnPruning", "false").schema(schema).csv(path)
    return df


def _typed(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _records(spark: SparkSession, path: str, dialect: CsvDialect) -> DataFrame:
    """Records with their line breaks, as ``value``; headers and blank lines left out."""
    found = read_records(spark, path, dialect.quote, dialect.escape, dialect.encoding)
    if dialect.header:
        found = found.where("record > 1")
    return found.select(F.regexp_replace("value", "\r$", "").alias("value")).where(
        F.trim("value") != "")


def _parsed(records: DataFrame, schema: StructType, dialect: CsvDialect) -> DataFrame:
    """Records by Spark's own parser, which marks those with differing fields."""
    marked = StructType([*schema.fields, StructField(NEVER, StringType())])
    options = {k: v for k, v in dialect.options().items() if k not in ("header", "encoding")}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": NEVER}
    rows = records.select(F.from_csv("value", marked.toDDL(), options).alias("row"))
    if dialect.skip_differing:
        rows = rows.where(F.col("row").getField(NEVER).isNull())
    return rows.select(*[F.col("row").getField(f.name).alias(f.name) for f in schema])


def _strict_quoted(spark: SparkSession, path: str, schema: StructType | str | None,
                   dialect: CsvDialect) -> DataFrame:
    """Only quoted text counts: ``1;"a"`` reads as ``(null, a)``."""
    if schema is None:
        raise ValueError("strict quotes need a schema")
    schema = _typed(schema)
    q, e, s = (_rx(c) for c in (dialect.quote, dialect.escape, dialect.sep))
    field = rf"\s*{q}((?:[^{q}{e}]|{e}.)*){q}\s*|([^{s}]*)"
    if dialect.multi_line:
        lines = _records(spark, path, dialect)
    else:  # whole lines, the first one of each file left out if it is the header
        lines = spark.read.options(
            sep="\u0001", quote="", escape="", encoding=dialect.encoding,
            header=str(dialect.header).lower()).schema("value string").csv(path)
    quoted = F.regexp_extract_all("value", F.lit(rf"(?s)(?:^|{s})(?:{field})"), F.lit(1))
    cells = F.transform(quoted, lambda c: F.when(c != "", F.regexp_replace(
        c, rf"(?s){e}(.)", "$1")))
    rows = lines.select(cells.alias("cells"))
    if dialect.skip_differing:
        rows = rows.where(F.size("cells") == len(schema))
    return rows.select(*[
        F.get("cells", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def _rx(char: str) -> str:
    return "\\" + char


def read_headerless(spark: SparkSession, path: str, names: Sequence[str],
                    sep: str = ",", quote: str = '"') -> DataFrame:
    """A headerless file, all columns text, named by position."""
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.option("sep", sep).option("quote", quote).schema(schema).csv(path)


def read_many(spark: SparkSession, paths: Mapping[str, str],
              schemas: Mapping[str, StructType | str] | None = None,
              dialect: CsvDialect = CsvDialect()) -> dict[str, DataFrame]:
    """Several delimited files as named tables."""
    schemas = schemas or {}
    return {name: read_csv(spark, path, schemas.get(name), dialect)
            for name, path in paths.items()}


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Parquet tables ``<folder>/<name>.parquet`` by name."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """``label, features``. The number of features, if known, saves a scan."""
    reader = spark.read.format("libsvm")
    if features:
        reader = reader.option("numFeatures", str(features))
    return reader.load(path)


def read_format(spark: SparkSession, fmt: str, path: str,
                schema: StructType | str | None = None) -> DataFrame:
    """``text``, ``json``, ``parquet`` and any other format Spark knows."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def jdbc_options(url: str, table: str, *, driver: str | None = None, user: str | None = None,
                 password: str | None = None, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None,
                 partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options of a database scan.

    A partition column with bounds splits the scan over that many tasks; without
    one a single task reads the whole table.
    """
    split = (partition_column, lower, upper, partitions)
    if any(x is not None for x in split) and any(x is None for x in split):
        raise ValueError("give partition_column, lower, upper and partitions together")
    options = {"url": url, "dbtable": table, "driver": driver, "user": user,
               "password": password, "fetchsize": fetch_size,
               "partitionColumn": partition_column, "lowerBound": lower,
               "upperBound": upper, "numPartitions": partitions}
    return {k: str(v) for k, v in options.items() if v is not None}


def read_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **kwargs) -> None:
    df.write.format("jdbc").mode(mode).options(**jdbc_options(url, table, **kwargs)).save()
