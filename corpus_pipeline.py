"""The corpus pipeline: documents in, mixed training corpus out.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, jaccard, langid, linededup, mixing
from loomwork.llm.registry import table
from loomwork.session import scratch_path

LEAST_KNOWN = 0.25  # of a text's n-grams, for its language to count
WIDTH, NUM, DEN = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those in no language that was learned.

    ``lang`` becomes the language found.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN)
                       & (F.col("known_share") >= LEAST_KNOWN))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of lines; drop texts left without lines."""
    cleaned = linededup.dedup_lines(docs)
    kept = cleaned.where("n_lines > n_removed")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest ``doc_id`` of every group of similar ones."""
    return jaccard.one_per_group(docs, WIDTH, NUM, DEN)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits.items") == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of copies of each."""
    taken = mixing.mix_sources(docs).where("copies > 0").select(
        F.col("doc_id"), "source", "size", "source_size", "target", "copies", "taken")
    return taken


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies),
          ("benchmarks", benchmarks), ("mixture", mixture)]

#: Language identification and near copies have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
