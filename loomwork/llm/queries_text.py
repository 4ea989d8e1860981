"""Queries that SQL cannot express: language, personal data, copies, passages, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import covertree, jaccard, langid, licenses, passages, pii
from loomwork.llm.registry import query, table


@query()
def op1_personal_data(spark, d):
    found = pii.find_personal_data(table(spark, d, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast(
        "long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE_KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query()
def op3_language(spark, d):
    docs = table(spark, d, "documents")
    apart = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~apart))
    return langid.identify(docs.select("doc_id", apart.alias("held_out"), "text"), model).drop(
        "text")


@query()
def op5_similar_documents(spark, d):
    return jaccard.similar_documents(table(spark, d, "documents"), width=3, num=90, den=100)


@query()
def op4_similar_vectors(spark, d):
    return covertree.similar_vectors(table(spark, d, "embeddings"))


@query()
def op6_repeated_passages(spark, d):
    return passages.repeated_passages(table(spark, d, "documents"))


@query()
def op7_license_scan(spark, d):
    docs = table(spark, d, "documents")
    return licenses.scan(docs, licenses.train(docs))
