"""File formats: a table is written to the scratch folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.catalog.profiling import SEVEN, _ind_sql
from loomwork.catalog.registry import COLUMNS, cells_sql, query, table
from loomwork.operators import projections
from loomwork.plans import inclusion, tree
from loomwork.session import scratch_path
from loomwork.sources import files

_NOTE = """CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN ''
                WHEN c_acctbal < 6000 THEN 'say "hi"; bye' ELSE c_mktsegment END"""


@query(f"SELECT c_custkey, c_name, c_acctbal, {_NOTE} AS note FROM customer")
def csv_dialect(spark, d):
    """Quotes, escapes and separators inside fields; nulls beside empty strings."""
    path = scratch_path(spark, "csv")
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.expr(_NOTE).alias("note"))
    rows.write.options(sep=";", quote='"', escape="\\", header="true").csv(path)
    return files.read_csv(spark, path, rows.schema)


@query("""SELECT doc_id, chr(10) || coalesce(text, '"') AS text, lang, source, n_chars
          FROM documents""")
def csv_multiline(spark, d):
    """Whole documents with quotes and line breaks, every text beginning with one."""
    path = scratch_path(spark, "multiline")
    rows = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("\n"), F.coalesce("text", F.lit('"'))).alias("text"), "lang",
        "source", "n_chars")
    rows.write.options(sep=";", quote='"', escape="\\", header="true", quoteAll="true",
                       ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
                       nullValue="\u0001").csv(path)
    return files.read_csv(spark, path, rows.schema, files.CsvDialect(
        multi_line=True, ignore_leading_blanks=False))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def csv_malformed(spark, d):
    """Orders of one status get a field too many, of another a field too few."""
    path = scratch_path(spark, "malformed")
    short = F.concat_ws(";", "o_orderkey", "o_custkey")
    line = (F.when(F.col("o_orderstatus") == "F", short)
            .when(F.col("o_orderstatus") == "P", F.concat_ws(";", short, "o_orderpriority",
                                                             F.lit("extra")))
            .otherwise(F.concat_ws(";", short, "o_orderpriority")))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return files.read_csv(
        spark, path, "o_orderkey long, o_custkey long, o_orderpriority string",
        files.CsvDialect(header=False, skip_differing=True))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ID, c_name AS Name, c_mktsegment AS Password,
                 CAST(c_nationkey AS VARCHAR) AS Gene FROM customer""")
def csv_headerless(spark, d):
    path = scratch_path(spark, "headerless")
    table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey").write.option(
        "quoteAll", "true").csv(path)
    return files.read_headerless(spark, path, ["ID", "Name", "Password", "Gene"])


@query(_ind_sql(cells_sql(SEVEN)))
def csv_inclusion(spark, d):
    """Several CSV files, types inferred, profiled for inclusion dependencies."""
    paths = {}
    for name in SEVEN:
        paths[name] = scratch_path(spark, name)
        table(spark, d, name).write.options(sep=";", header="true").csv(paths[name])
    return inclusion.inclusion_report(files.read_many(spark, paths))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def json_scan(spark, d):
    path = scratch_path(spark, "json")
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    rows.write.json(path)
    return files.read_format(spark, "json", path, rows.schema)


@query("SELECT p_name || ' / ' || p_type AS value FROM part")
def text_scan(spark, d):
    path = scratch_path(spark, "text")
    table(spark, d, "part").select(
        F.concat("p_name", F.lit(" / "), "p_type").alias("value")).write.text(path)
    return files.read_format(spark, "text", path)


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region "
       "ON n_regionkey = r_regionkey")
def parquet_scan(spark, d):
    t = files.read_tables(spark, d, ["nation", "region"])
    return t["nation"].join(
        t["region"].withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(
        "n_nationkey", "n_name", "n_regionkey", "r_name")


@query("""SELECT CAST(vec_id AS DOUBLE) AS label, CAST(unnest(range(len(embedding))) AS INTEGER)
                 AS position, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""")
def libsvm_scan(spark, d):
    """All vectors, written with their number as label, and read back."""
    path = scratch_path(spark, "libsvm")
    tree.labelled_vectors(table(spark, d, "embeddings"), "vec_id", "embedding").write.format(
        "libsvm").save(path)
    return files.read_libsvm(spark, path, features=64).select(
        "label", F.posexplode(vector_to_array("features")).alias("position", "value"))


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS source, {i} AS nr, count(DISTINCT {c}) AS distinct_values FROM {t}"
    for t in SEVEN for i, c in enumerate(COLUMNS[t])))
def single_column_tables(spark, d):
    """Every column of every table as a table of its own."""
    counted = [
        column.toDF("v").agg(F.countDistinct("v").alias("distinct_values")).select(
            F.lit(name).alias("source"), F.lit(i).alias("nr"), "distinct_values")
        for name in SEVEN for i, column in enumerate(
            projections.single_columns(table(spark, d, name).select(*COLUMNS[name])))]
    return reduce(DataFrame.unionAll, counted)
