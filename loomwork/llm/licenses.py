"""Licence statements by a trained paragraph classifier, native."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

CORPUS_WEIGHT = 4  # of all sentences of the corpus together, in examples for each one given
STEPS = 10_000  # of a probability, for the threshold
UNKNOWN = "unknown"

# Public licence statements by family, and sentences that only sound like one.
TEMPLATES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.",
             "This program is licensed under the GNU Affero General Public License."],
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use "
               "this file except in compliance with the License."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions of the license are met."],
    "CC-BY": ["Licensed under CC BY 4.0.",
              "This work is licensed under the Creative Commons Attribution 4.0 "
              "International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 "
                 "International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 "
                 "International License."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU General Public License, version 2.",
            "Released under the GPL license.",
            "This program is free software under the terms of the GNU General Public License as "
            "published by the Free Software Foundation."],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC License."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files."],
    "MPL": ["Licensed under the Mozilla Public License, Version 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License."],
    "proprietary": ["All rights reserved.", "Copyright by the authors, all rights reserved."],
    "public-domain": ["Released into the public domain.",
                      "This work is dedicated to the public domain under the CC0 license."],
}
SOUND_ALIKE = [
    "He lost his driving licence in the spring.", "The license plate was hard to read.",
    "A fishing license is sold at the counter.", "The copyright office is closed on Sundays.",
    "Poetic licence is part of the trade.", "Permission slips are due on Friday.",
    "She reserved all rights to complain.", "The public domain of the king was large.",
    "License fees rose by ten percent.", "The permission of the owner was asked.",
    "Copyright law is taught in the second year.", "The patent was licensed to a factory.",
]
#: A statement has one of these words; only such paragraphs are looked at.
ANCHORS = ("licens", "licenc", "copyright", "rights reserved", "public domain", "permission",
           "cc by", "cc0", "redistribution", "mozilla public", "gpl")
_ANCHOR = r"(?i)\b(?:licen[sc]|copyright|rights reserved\b|public domain\b|permission|cc by\b|" \
    r"cc0\b|redistribution|mozilla public\b|gpl\b)"


def _tokens(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[.][0-9]+)*"), F.lit(0))


def _pairs(words) -> F.Column:
    """Word pairs, with the borders of the sentence."""
    return F.zip_with(F.concat(F.array(F.lit("^")), words), F.concat(words, F.array(F.lit("$"))),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def _anchored(text) -> F.Column:
    """Holds an anchor at the begin of a word; the plain search rules most texts out."""
    low = F.lower(text)
    found = F.contains(low, F.lit(ANCHORS[0]))
    for word in ANCHORS[1:]:
        found = found | F.contains(low, F.lit(word))
    return found & text.rlike(_ANCHOR)


def sentences(docs: DataFrame) -> DataFrame:
    """The paragraphs (lines) of ``docs`` in sentences: ``doc_id, paragraph, sentence, text``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    cut = F.split("line", r"(?<=[.!?;])\s+(?=[A-Z\"(])")
    return lines.select("doc_id", "paragraph", F.posexplode(cut).alias("sentence", "text"))


def _given() -> list[tuple[str, str]]:
    """Templates whole and with each word left out, and sentences that sound alike."""
    rows = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, SOUND_ALIKE)]:
        for text in texts:
            words = text.split()
            rows += [(family, text)] * 4
            if len(words) > 4:
                rows += [(family, " ".join(words[:i] + words[i + 1:])) for i in range(len(words))]
    return rows


def _vocabulary() -> list[str]:
    """Words and word pairs of the given examples."""
    held = set()
    for _, text in _given():
        words = re.findall("[a-z0-9]+(?:[.][0-9]+)*", text.lower())
        held |= {*words, *map(" ".join, zip(["^", *words], [*words, "$"]))}
    return sorted(held)


def _features(rows: DataFrame) -> DataFrame:
    """Which words and word pairs of the given examples a sentence has."""
    words = rows.withColumn("words", _tokens(F.col("text")))
    grams = words.withColumn("grams", F.concat("words", _pairs(F.col("words"))))
    return CountVectorizerModel.from_vocabulary(
        _vocabulary(), inputCol="grams", outputCol="features", binary=True).transform(
        grams).drop("grams")


class Scanner:
    """A trained classifier with the probability that a known family has to reach."""

    def __init__(self, model, families: list[str], threshold: float):
        self.model, self.families, self.threshold = model, families, threshold

    def likeliest(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``keep``, and ``family`` and ``probability`` of the likeliest known family."""
        scored = self.model.transform(rows)
        known = F.slice(vector_to_array("probability"), 1, len(self.families) - 1)
        names = F.array(*[F.lit(f) for f in self.families[:-1]])
        return scored.withColumn("known", known).select(
            *keep, F.array_max("known").alias("probability"),
            F.element_at(names, F.array_position("known", F.array_max("known")).cast("int"))
            .alias("family"))

    def best(self, rows: DataFrame) -> DataFrame:
        """Add ``words``, and ``family`` and ``probability`` of the likeliest known family."""
        return self.likeliest(_features(rows), *rows.columns, "words")


def train(docs: DataFrame) -> Scanner:
    """Fit on the templates, and on the sentences of all documents for the unknown class.

    Different sentences without an anchor word are dealt in two halves by a hash, one to
    train, one to calibrate; those with the same features are one example with their number
    as weight, and all of them together weigh ``CORPUS_WEIGHT`` for each given example. The
    threshold is the probability that 99 of 100 unknown sentences of the other half stay
    below, one half at least, rounded up to ``1 / STEPS``."""
    spark = docs.sparkSession
    families = [*sorted(TEMPLATES), UNKNOWN]
    plain = sentences(docs.select("doc_id", "text")).where(~_anchored(F.col("text")))
    patterns = materialize(
        _features(plain.select("text")).select(F.xxhash64("text").alias("sentence"), "features")
        .distinct().groupBy(F.pmod("sentence", F.lit(2)).alias("half"), "features").agg(
            F.count("*").alias("n")), "unknown")
    given = _given()
    n = patterns.where("half = 0").agg(F.sum("n")).first()[0] or 1
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    known = _features(spark.createDataFrame(given, "family string, text string"))
    fit = materialize(known.select("family", "features", F.lit(1.0).alias("weight")).unionByName(
        patterns.where("half = 0").select(
            F.lit(UNKNOWN).alias("family"), "features",
            (F.col("n") * (CORPUS_WEIGHT * len(given) / n)).alias("weight"))).select(
        label.cast("double").alias("label"), "features", "weight"), "examples")
    model = LogisticRegression(maxIter=40, regParam=1e-4, family="multinomial",
                               weightCol="weight").fit(fit)
    scanner = Scanner(model, families, 0.5)
    step = F.ceil(F.col("probability") * STEPS)
    limit = scanner.likeliest(patterns.where("half = 1"), "n").agg(
        F.percentile(step, 0.99, F.col("n"))).first()[0]
    scanner.threshold = max(0.5, (limit or 0.0) / STEPS)
    return scanner


def scan(docs: DataFrame, scanner: Scanner, overlap: float = 0.6) -> DataFrame:
    """Licence statements in ``docs``.

    A sentence with one of the anchor words is classified by logistic regression on
    its words and word pairs. If a known family reaches the calibrated threshold,
    its templates confirm it: one has to share ``overlap`` of the word pairs of the
    larger side. Anything else with an anchor is the family ``unknown``.

    ``docs`` needs ``doc_id, text``; other columns are ignored. One row per sentence:
    ``doc_id, paragraph, sentence, family, statement``; numbers from 0. Null and empty
    texts and texts without anchors give no rows; repeated rows repeat theirs.
    Nothing is shuffled.
    """
    held = docs.select("doc_id", "text").where(_anchored(F.col("text")))
    rows = scanner.best(sentences(held).where(_anchored(F.col("text"))))
    known = F.array(*[
        F.struct(F.lit(f).alias("family"), _pairs(_tokens(F.lit(t))).alias("pairs"))
        for f, texts in TEMPLATES.items() for t in texts])
    pairs = F.array_distinct(_pairs(F.col("words")))
    confirmed = F.exists(known, lambda t: (t["family"] == F.col("family")) & (
        F.size(F.array_intersect(t["pairs"], F.col("pairs")))
        >= overlap * F.greatest(F.size(t["pairs"]), F.size("pairs"))))
    sure = (F.col("probability") >= scanner.threshold) & confirmed
    return rows.withColumn("pairs", pairs).select(
        "doc_id", "paragraph", "sentence",
        F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.col("text").alias("statement"))
