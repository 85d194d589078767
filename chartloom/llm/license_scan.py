"""Licence scans of whole texts, with DataFrame functions and JVM learners only.

Every paragraph (a line; long ones in overlapping windows of words) is classified by a multinomial
logistic regression on sparse word one- and two-grams, trained here on licence notices in varied
surroundings against paragraphs of the corpus. A paragraph without a gram that speaks for some family
more than for none can't be likelier a licence than not, so only the others are scored. The probability from which a family is believed
is calibrated on held-out notices; what is licence-like below it is ``unknown``. A prediction is
confirmed when the paragraph holds most two-grams of one of the family's notices.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom.functions.text import bind
from chartloom.llm.common import stored, text_of

#: Words of a window and words between their starts.
WINDOW_WORDS, STRIDE_WORDS = 60, 30
#: Documents and paragraphs that the learner gets from the corpus, at most.
MOST_DOCUMENTS, MOST_PARAGRAPHS = 300, 1_500
#: Share of believed held-out notices that must be right, and share of a notice's two-grams that confirms.
PRECISION, CONFIRMING = 0.995, 0.7
NONE, UNKNOWN = "none", "unknown"

NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    ],
    "mit": [
        "Released under the MIT License",
        "This software is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "proprietary": ["All rights reserved", "Copyright by the authors. All rights reserved", "No part of this publication may be reproduced without prior written permission of the publisher"],
}
#: Sentences with words of notices that are none.
LOOKALIKES = [
    "She got her driving license last version of the summer", "The general public was reserved about the work",
    "All seats are reserved for the general public", "The apache helicopter was released on Monday",
    "He was reserved and all his rights were known", "MIT is a university in Cambridge", "The source of the river is open to the public",
    "Version 3 of the plan was released", "This work is under review", "The city licensed the taxi driver under the old law",
    "People demand their rights", "Version 2.0 of the software is free of charge", "The foundation of the house is free of damage",
]
SURROUNDINGS = ["{}", "{}.", "Copyright 2020. {}.", "{} see the file for details", "Note: {}", "{} https://example.org/license"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")


def grams_of(words: Column) -> Column:
    """One- and two-grams."""
    pairs = F.zip_with(
        words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(words, F.filter(pairs, lambda pair: pair.isNotNull()))


def paragraphs(rows: DataFrame) -> DataFrame:
    """``key, paragraph, window, words`` of ``key, text``: every line with a word, long ones in windows."""
    lines = rows.select("key", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    n_windows = lambda words: F.greatest(F.ceil((F.size(words) - WINDOW_WORDS) / F.lit(float(STRIDE_WORDS))), F.lit(0)).cast("int")
    windows = bind(
        words_of(F.col("line")),
        lambda words: F.transform(
            F.sequence(F.lit(0), n_windows(words)), lambda i: F.slice(words, i * STRIDE_WORDS + 1, WINDOW_WORDS)
        ),
    )
    return lines.select("key", "paragraph", F.posexplode(windows).alias("window", "words")).where(F.size("words") > 0)


def _inline(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few constant rows, made in the JVM."""
    row = lambda values: F.struct(*(F.lit(v).alias(n) for v, n in zip(values, names)))
    return spark.range(1).select(F.inline(F.array(*map(row, rows))))


def _training_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``family, words, held_out, notice``: notices in surroundings and in corpus words, and corpus paragraphs."""
    some = docs.select("key").where("key is not null").distinct().orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(MOST_DOCUMENTS)
    taken = docs.join(F.broadcast(some), "key", "left_semi")
    known = ("license", "licensed", "licence", "copyright", "reserved", "redistribution", "creative", "gnu", "permission")
    text = F.array_join("words", " ")
    corpus = (
        paragraphs(taken)
        .where(~F.arrays_overlap("words", F.array(*(F.lit(w) for w in known))))
        .select("words").distinct().orderBy(F.xxhash64(text), text).limit(MOST_PARAGRAPHS)
    )
    corpus = stored(corpus.coalesce(1), "licence-corpus")
    forms = [
        (family, j % 3 == 1, form.format(words))
        for family, texts in NOTICES.items() for words in texts for j, form in enumerate(SURROUNDINGS)
    ]
    notices = _inline(spark, forms, ["family", "held_out", "text"]).select("family", words_of(F.col("text")).alias("words"), "held_out")
    lookalikes = _inline(spark, [(NONE, False, words) for words in LOOKALIKES], ["family", "held_out", "text"]).select(
        "family", words_of(F.col("text")).alias("words"), "held_out"
    )
    around = corpus.groupBy(F.pmod(F.xxhash64(text), F.lit(60)).alias("at")).agg(F.min("words").alias("around"))
    placed = notices.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn(
        "at", F.pmod(F.xxhash64("family", text, "slot"), F.lit(60))
    )
    embedded = placed.join(F.broadcast(around), "at").select(
        "family",
        F.when(F.col("slot") % 2 == 0, F.concat(F.slice("around", 1, 12), "words")).otherwise(F.concat("words", F.slice("around", 1, 20))).alias("words"),
        (F.col("slot") == 5).alias("held_out"),
    )
    ordinary = corpus.select(F.lit(NONE).alias("family"), "words", (F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("held_out"))
    plain = notices.unionByName(lookalikes).withColumn("notice", F.lit(True))
    return plain.unionByName(embedded.unionByName(ordinary).withColumn("notice", F.lit(False)))


class LicenceModel:
    """Vocabulary of notices, regression over it, believed probability and the grams that speak for a family."""

    def __init__(self, counts: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str]):
        self.counts, self.regression, self.families, self.believed = counts, regression, families, 0.5
        weights, biases = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
        none = families.index(NONE)
        if (biases > biases[none]).any():
            raise ValueError("a paragraph without any known gram would be taken for a licence")
        self.speaking = [gram for gram, above in zip(counts.vocabulary, (weights > weights[none]).any(axis=0)) if above]

    def predicted(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (the likeliest, or none) and its ``probability`` to rows with ``grams``."""
        scored = self.regression.transform(self.counts.transform(rows)).withColumn("shares", vector_to_array("probability"))
        scored = scored.drop("features", "probability")
        best = F.array_max(F.transform(F.col("shares"), lambda p, i: F.struct(p.alias("p"), (-i).alias("minus"))))
        names = F.array(*(F.lit(f) for f in self.families))
        return scored.withColumn("best", best).select(
            *(c for c in scored.columns if c != "shares"),
            F.element_at(names, (1 - F.col("best.minus")).cast("int")).alias("family"),
            F.col("best.p").alias("probability"),
        )


def train(docs: DataFrame) -> LicenceModel:
    """The model, and the probability from which a family is believed: the smallest one at which at least
    ``PRECISION`` of the held-out rows predicted to be a licence with it or more are right."""
    families = [NONE, *sorted(NOTICES)]
    rows = _training_rows(docs.sparkSession, docs).withColumn("grams", grams_of(F.col("words"))).withColumn(
        "label", (F.array_position(F.array(*(F.lit(f) for f in families)), F.col("family")) - 1).cast("double")
    )
    rows = stored(rows.coalesce(2), "licence-training")
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=50_000).fit(rows.where("notice"))
    learner = LogisticRegression(family="multinomial", regParam=2e-3, elasticNetParam=1.0, maxIter=60)
    regression = learner.fit(counts.transform(rows.where("not held_out")))
    regression.setPredictionCol("").setRawPredictionCol("")
    model = LicenceModel(counts, regression, families)
    tried = model.predicted(rows.where("held_out").select(F.col("family").alias("truth"), "grams")).where(F.col("family") != NONE)
    believed, right = 0.99, 0
    outcomes = tried.select("probability", F.col("family") == F.col("truth")).collect()  # a few hundred notices
    for n, (probability, is_right) in enumerate(sorted(map(tuple, outcomes), reverse=True), 1):
        right += is_right
        if right >= PRECISION * n:
            believed = min(believed, probability)
    model.believed = max(believed, 0.5)
    return model


def scan_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``<id>, paragraph, window, family, probability, template_share, confirmed`` of every paragraph that
    isn't predicted to be free of a licence.

    ``family`` is ``unknown`` below the calibrated probability when the templates don't confirm it either.
    Null and empty texts have no paragraph; null ids and repeated rows are scanned like any other; equal
    probabilities go to the first family in the alphabet; an empty table gives no rows. Other columns are
    not looked at.
    """
    rows = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    model = train(rows)
    speaking = F.array(*(F.lit(gram) for gram in model.speaking))
    worth = paragraphs(rows).where(F.arrays_overlap(grams_of(F.col("words")), speaking))
    worth = stored(worth, "licence-paragraphs")
    found = model.predicted(worth.withColumn("grams", grams_of(F.col("words")))).where(F.col("family") != NONE)
    own = lambda text: bind(words_of(F.lit(text)), lambda w: F.array_except(grams_of(w), w))
    pairs = F.array_except("grams", "words")
    share = F.lit(0.0)
    for family, texts in NOTICES.items():
        held = F.greatest(*(F.size(F.array_intersect(pairs, own(t))) / F.size(own(t)) for t in texts), F.lit(0.0))
        share = F.when(F.col("family") == family, held).otherwise(share)
    found = stored(found.withColumn("template_share", share), "licences")
    confirmed = F.col("template_share") >= CONFIRMING
    return found.select(
        F.col("key").alias(id_column),
        "paragraph",
        "window",
        F.when(confirmed | (F.col("probability") >= model.believed), F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round("template_share", 6).alias("template_share"),
        confirmed.alias("confirmed"),
    )
