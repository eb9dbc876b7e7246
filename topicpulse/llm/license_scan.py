"""License scan: a paragraph classifier over word n-grams, confirmed against templates.

Built of DataFrame and SQL functions and the JVM's feature and regression classes
only. The classifier (multinomial logistic regression with an L1 penalty, so that
it stays sparse) is trained on the notices below, on windows of them, and on
paragraphs of no license: all those of the corpus and sentences that
use the same words for other things. Every n-gram of the vocabulary holds a cue,
a word of the notices that is rare in the corpus. A paragraph without a cue
therefore has no features at all, is of class "none" by its intercept, and needn't
be scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import id_and_text

NONE, UNKNOWN = "none", "unknown"

#: Different feature vectors of a training task.
VECTORS = 50_000

# Names and notices of license families, as their publishers word them.
FAMILIES = {
    "Apache-2.0": ("Apache License, Version 2.0", [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."]),
    "MIT": ("MIT License", [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."]),
    "BSD-3-Clause": ("BSD 3-Clause License", [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."]),
    "GPL-2.0": ("GNU General Public License, version 2", [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License"]),
    "GPL-3.0": ("GNU General Public License, version 3", [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"]),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"]),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", [
        "You should have received a copy of the GNU Affero General Public License along with this program."]),
    "MPL-2.0": ("Mozilla Public License, version 2.0", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at"]),
    "ISC": ("ISC License", [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    "Unlicense": ("Unlicense", [
        "This is free and unencumbered software released into the public domain."]),
    "CC0-1.0": ("CC0 1.0 Universal", [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work. Creative Commons Zero Public Domain Dedication"]),
    "CC-BY-4.0": ("CC BY 4.0", [
        "This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
}
STATEMENTS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.",
              "This work is licensed under the {}.", "This work is licensed under {}.",
              "This project is available under the terms of the {}.", "Distributed under the {}.",
              "License: {}", "SPDX-License-Identifier: {}"]
# Sentences without a license that use words of the notices.
OTHERS = [
    "The driver showed a license and the police officer let the car pass without conditions.",
    "A fishing license is required by law for any person above the age of twelve.",
    "The software was distributed to all offices and the author wrote a short notice about it.",
    "Copyright law has changed and the rights of the holder are now easier to enforce.",
    "The general public was granted permission to use the library free of charge.",
    "The apache helicopter was released after the war and the foundation paid for a copy.",
    "The company shall provide a warranty of two years for every product sold.",
    "He works in the commercial arts and was published in an international magazine.",
    "The terms of the agreement were modified and the source of the files is not known.",
    "Creative people share their work with the commons and get attribution for it.",
    "Version 3 of the program is faster than version 2.0 and needs no documentation.",
    "This work is a file of forms, and either part may be included without restriction.",
    "Her license expired last year and a new license was issued in the spring.",
    "The pilot lost the license after the accident, and the license plate was never found.",
    "The band released under a different name and the record was licensed to a film.",
    "A copy of the law is available at the office, and a license costs ten dollars.",
]
# What is in no paragraph that stands for "none".
SPEAKING = ["license", "licence", "copyright", "spdx", "creative commons"]


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case. No words: an empty array."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    """Runs of n words joined by spaces, none if there are fewer."""
    return F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def all_grams(w: Column) -> Column:
    return F.concat(w, grams(w, 2), grams(w, 3))


def licensed(text: Column, w: Column, n: int = 8) -> Column:
    """True if the text (``w``: its words) speaks of licenses, or holds a statement or n words in a row of a notice."""
    runs: dict[int, set[str]] = {}
    for t in (t.split() for family in FAMILIES for t in _templates(family)):
        k = min(n, len(t))
        for run in (" ".join(t[i:i + k]) for i in range(len(t) - k + 1)):
            if not any(x in run for x in SPEAKING):
                runs.setdefault(k, set()).add(run)

    # a text without any run's longest word has no run; few runs of the others start with the right word
    longest = {max(run.split(), key=len) for some in runs.values() for run in some}
    starts = {run.split()[0] for some in runs.values() for run in some}

    def run_at(i: Column) -> Column:
        return F.get(w, i).isin(sorted(starts)) & reduce(Column.__or__, [
            F.array_join(F.slice(w, i + 1, k), " ").isin(sorted(some)) for k, some in sorted(runs.items())])
    return F.exists(F.array(F.lower(text)), lambda t: reduce(Column.__or__, [t.contains(x) for x in SPEAKING])) \
        | (F.arrays_overlap(w, F.lit(sorted(longest)))
           & F.exists(F.sequence(F.lit(0), F.size(w) - 1), run_at))


def rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as a literal."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names)]) for v in values])))


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, paragraph, text): the lines with a word of each text, numbered from 0 over all its lines."""
    return id_and_text(df, id_col, text_col).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text")).where(F.length(F.trim("text")) > 0)


class LicenseModel:
    """Classifier, unknown threshold and templates; ``cues`` are the words without which nothing is scored."""

    def __init__(self, vectorizer, regression, labels: list[str], cues: list[str], threshold: float):
        self.vectorizer, self.regression, self.labels = vectorizer, regression, labels
        self.cues, self.threshold = cues, threshold

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds p: an array of probabilities, in the order of labels."""
        out = self.regression.transform(self.vectorizer.transform(df.withColumn("grams", all_grams(F.col("w")))))
        return out.withColumn("p", vector_to_array("probability")).drop(
            "grams", "features", "rawPrediction", "probability", "prediction")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", background_share: float = 0.01,
          false_alarms: float = 0.005, background_weight: float = 2.0) -> LicenseModel:
    """Fits the classifier on all paragraphs of the table, which is read twice.

    Paragraphs that speak of licenses or quote a notice are no examples of "none";
    all others are, and stand as numbers of equal feature vectors. A word of the
    notices is a cue if at most ``background_share`` of these paragraphs have it.
    Together they weigh at most ``background_weight`` times the notices and their
    windows, so that the penalty means the same for small and large tables. The
    unknown class is calibrated on paragraphs held out, a fifth of all: the
    probability from which on a paragraph counts as a license is the one that at
    most ``false_alarms`` of those without a license reach, 0.5 at least.
    """
    spark = df.sparkSession
    labels = [NONE, *FAMILIES]
    texts = []
    for k, (family, (name, notices)) in enumerate(FAMILIES.items(), 1):
        texts += [(k, x) for x in notices] + [(k, s.format(name)) for s in STATEMENTS]
        texts += [(k, s.format(family)) for s in STATEMENTS]
    known = rows(spark, texts, ["label", "text"]).select("label", words(F.col("text")).alias("w"))
    # windows of the notices stand for shortened and wrapped ones
    windows = known.select("label", F.explode(F.array(F.lit(8), F.lit(13))).alias("n"), "w") \
        .where(F.size("w") > F.col("n")).select("label", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("w"))
    others = rows(spark, [(0, x) for x in OTHERS], ["label", "text"]).select("label", words(F.col("text")).alias("w"))
    others = others.unionByName(others.select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 5, F.lit(1)), F.lit(2)), lambda i: F.slice("w", i, 6))).alias("w")))
    # generated, so that a filter on the words doesn't split the text again at each mention of them
    background = paragraphs(df, id_col, text_col).select("text", F.explode(F.array(words(F.col("text")))).alias("w")) \
        .where((F.size("w") > 0) & ~licensed(F.col("text"), F.col("w"))).select("w")
    noted = sorted(r["x"] for r in known.select(F.explode("w").alias("x")).distinct().collect())
    # of each paragraph its different words of the notices, and "" for itself
    having = {r["x"]: r["n"] for r in background.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(
        F.filter("w", lambda x: x.isin(noted))))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}
    cues = [x for x in noted if having.get(x, 0) <= background_share * having.get("", 0) and not x.isdigit()]
    has_cue = lambda g: F.arrays_overlap(F.split(g, " "), F.lit(cues))      # noqa: E731
    vocabulary = sorted(r["g"] for r in known.select(
        F.explode(all_grams(F.col("w"))).alias("g")).distinct().where(has_cue(F.col("g"))).collect())
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    vectorizer.setBinary(True)
    held_out = (F.pmod(F.xxhash64("w"), F.lit(5)) == 0) & (F.col("label") == 0)
    # a cue alone makes no license
    alone = rows(spark, [(0, x) for x in cues], ["label", "text"]).select("label", F.array("text").alias("w"))
    fixed = vectorizer.transform(reduce(DataFrame.unionByName, [known, windows, others, alone]).select(
        "label", held_out.alias("held_out"), all_grams(F.col("w")).alias("grams"))) \
        .select("label", "held_out", F.lit(False).alias("corpus"), "features", F.lit(1).cast("long").alias("n"))
    counted = vectorizer.transform(background.withColumn("label", F.lit(0)).select(
        "label", held_out.alias("held_out"), F.when(F.arrays_overlap("w", F.lit(cues)), all_grams(F.col("w")))
        .otherwise(F.array().cast("array<string>")).alias("grams"))) \
        .groupBy("label", "held_out", "features").agg(F.count(F.lit(1)).alias("n"))
    data = fixed.unionByName(counted.withColumn("corpus", F.lit(True))).cache()
    try:
        sums = data.where("not held_out").agg(
            F.sum(F.when(F.col("label") > 0, F.col("n"))).alias("licenses"),
            F.sum(F.when(F.col("corpus"), F.col("n"))).alias("background"), F.count(F.lit(1)).alias("vectors")).first()
        share = min(1.0, background_weight * sums["licenses"] / max(1, sums["background"] or 0))
        features = data.where("not held_out").select(
            F.col("label").cast("double").alias("label"), "features",
            (F.col("n") * F.when(F.col("corpus"), share).otherwise(1.0)).alias("weight")) \
            .coalesce(max(2, sums["vectors"] // VECTORS)).sortWithinPartitions("label", "features", "weight")
        regression = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.0005, maxIter=40,
                                        standardization=False, weightCol="weight").fit(features)
        # values outside the limits count as the limits, so the percentile holds few of them at any size
        alarm = regression.transform(data.where("held_out")).select(F.least(F.lit(0.95), F.greatest(
            F.lit(0.5), F.round(1 - F.get(vector_to_array("probability"), 0), 6))).alias("x"), "n") \
            .agg(F.expr(f"percentile(x, {1 - false_alarms}, n)")).first()[0]
        return LicenseModel(vectorizer, regression, labels, cues, alarm or 0.5)
    finally:
        data.unpersist()


def scan(df: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text",
         similarity: float = 0.8) -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed): one row for each paragraph with a license.

    ``paragraph`` numbers the lines of the text from 0. ``family``: the likeliest
    one if its probability reaches the calibrated threshold, "unknown" if only the
    families together reach it. ``similarity``: the largest overlap of word
    triples (shared ones over those of the shorter) with a notice of the likeliest
    family; ``confirmed`` if a known family has at least ``similarity``. Null and
    empty texts have no paragraphs; ids may be null; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    Nothing is shuffled.
    """
    model = model or train(df, id_col, text_col)
    found = paragraphs(df, id_col, text_col).withColumn("w", words(F.col("text"))).where(
        F.arrays_overlap("w", F.lit(model.cues)))
    found = model.probabilities(found).where(1 - F.col("p")[0] >= model.threshold)
    families = F.lit(model.labels[1:])
    best = F.array_max(F.slice("p", 2, len(model.labels)))
    place = F.array_position(F.slice("p", 2, len(model.labels)), best).cast("int")
    templates = F.array(*[F.array(*[F.lit(t) for t in _templates(family)]) for family in FAMILIES])
    triples = F.array_distinct(grams(F.col("w"), 3))
    overlap = F.transform(F.col("notices"), lambda t: F.size(F.array_intersect("triples", grams(F.split(t, " "), 3)))
                          / F.greatest(F.lit(1), F.least(F.size("triples"), F.size(F.array_distinct(
                              grams(F.split(t, " "), 3))))))
    found = found.select("doc_id", "paragraph", triples.alias("triples"), best.alias("best"),
                         F.get(families, place - 1).alias("likeliest"), F.get(templates, place - 1).alias("notices"),
                         (1 - F.col("p")[0]).alias("licensed"))
    sure = F.col("best") >= model.threshold
    return found.withColumn("similarity", F.round(F.array_max(overlap), 6)).select(
        F.col("doc_id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"),
        F.when(sure, F.col("likeliest")).otherwise(UNKNOWN).alias("family"),
        F.round(F.when(sure, F.col("best")).otherwise(F.col("licensed")), 6).alias("probability"),
        "similarity", (sure & (F.col("similarity") >= similarity)).alias("confirmed"))


def _templates(family: str) -> list[str]:
    """Notices and statements of a family as words joined by spaces."""
    name, notices = FAMILIES[family]
    texts = notices + [s.format(x) for s in STATEMENTS for x in (name, family)]
    clean = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()     # noqa: E731
    return [" ".join(clean(t)) for t in texts]
