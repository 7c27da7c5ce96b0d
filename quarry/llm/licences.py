"""Licence scan: a trained paragraph classifier, in DataFrame and SQL functions only.

Paragraphs are the non-blank lines of a text. Features are the presence of lower-cased word
one- and two-grams. Training rows: every licence template whole, with each of its words left
out, and inside ordinary paragraphs (``PLACED`` each); statements of made-up licences as the class ``unknown``;
and a bounded sample of the corpus' own paragraphs that hold no template as ``none``
(``NONE_ROWS``, by smallest hash). A sparse multinomial logistic regression (L1) is fitted
over the n-grams of the licence rows; its non-zero weights are broadcast to the scan,
which adds them up per paragraph with partial sums in the tasks. A temperature calibrates the
probabilities: it is fitted on rows of templates that a first fit has not seen in any form (the
last template of each family that has several), so it answers for new wording; the second
fit, on all rows, is the one used. A licence statement whose best family stays below
``CERTAIN`` is ``unknown``. A predicted family is confirmed if one of its
templates has at least ``SIMILAR`` of its word five-grams in the paragraph.

Ties: of equal top scores the family that comes first by name is taken; of equal
similarities the templates are not told apart.

Defined results: a very long text is as many rows as it has lines, a very long line one row of
its distinct n-grams; null, empty and blank texts have no paragraphs; paragraphs without any
weighted n-gram are ordinary text and give no row, nor do those classed ``none``; rows that
repeat a document exactly give its findings once; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import smallest, stored

#: The licence families and the texts they are known by.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("gpl-2.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Released under the ISC License."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "No part of this work may be reproduced without the prior written permission of the publisher."),
]
#: Statements of licences of no family; ``%`` becomes a word of the corpus.
UNKNOWN = [
    "Licensed under the % License.",
    "Released under the % % License, version 1.",
    "This work is licensed under the % Public Licence.",
    "This project is licensed under the terms of the % agreement.",
    "Use of this text is subject to the % licence terms.",
    "Distributed under the % Software Licence, Version 5.1.",
]
NONE_ROWS = 3000
UNKNOWN_ROWS = 30
#: Ordinary paragraphs that every licence row is placed in.
PLACED = 6
CERTAIN = 0.5
SIMILAR = 0.8
GRAM = 5
PENALTY = 2e-4
#: Findings (four narrow columns each) that may be broadcast.
BROADCAST_ROWS = 500_000
WORD = r"[^\p{L}\p{N}]+"


def words(text) -> F.Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def features(w) -> F.Column:
    """Hashes of the words, and of each word's hash with the next one's."""
    hs = F.transform(w, lambda x: F.xxhash64(x))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.element_at(hs, i), F.element_at(hs, i + 1)))
    return F.array_distinct(F.concat(hs, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<long>"))))


def shingles(w, n: int = GRAM) -> F.Column:
    """Hashes of the n-grams; of the whole where there are fewer words."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.array_distinct(F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
        F.array().cast("array<long>")))


def _rows(spark: SparkSession, values: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A few fixed rows, as literals of the plan."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in values])
    return spark.range(1).select(F.inline(rows))


def templates(spark: SparkSession) -> DataFrame:
    rows = _rows(spark, [(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], ("template", "family", "words"))
    return rows.withColumn("words", words(F.col("words"))).withColumn("grams", shingles(F.col("words")))


#: A paragraph of one text: rows without an id or with the same one are told apart by the text.
KEY = ("doc_id", "whole", "paragraph")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, whole (hash of the document's text, which tells rows of one id apart),
    paragraph (line number from 0), text of the non-blank lines."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("whole"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return rows.filter(F.trim(F.col("text"), F.lit(" \r\t")) != "")


def training_rows(docs: DataFrame, none_rows: int = NONE_ROWS) -> DataFrame:
    """template (-1: none), family, words, bare (a licence row by itself): bounded by the
    templates and ``none_rows``."""
    spark = docs.sparkSession
    known = templates(spark)
    held = F.array(*[F.lit(h) for r in known.select("grams").collect() for h in r["grams"]])  # of the fixed templates
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1  # blank ones too: about the paragraphs
    total = docs.agg(F.coalesce(F.sum(lines), F.lit(0)).alias("n")).first()["n"]
    sample = smallest(paragraphs(docs), F.xxhash64(*KEY), none_rows, total, "sampled-paragraphs", F.col("text"))
    plain = sample.select(words(F.col("text")).alias("words")).filter(~F.arrays_overlap(shingles(F.col("words")), held))
    plain = stored(plain.select(F.row_number().over(_by_hash()).alias("i"), "words"), "plain-paragraphs")
    whole = known.select("template", "family", "words")
    missing = known.filter(F.size("words") > 3).select("template", "family", F.explode(F.transform(
        "words", lambda _, i: F.filter("words", lambda __, j: j != i))).alias("words"))
    statements = F.explode(F.array(*[F.replace(F.lit(t), F.lit("%"), F.element_at("words", 1)) for t in UNKNOWN]))
    other = plain.filter(F.col("i") <= UNKNOWN_ROWS).select(statements.alias("text")).select(
        F.lit(-1).alias("template"), F.lit("unknown").alias("family"), words(F.col("text")).alias("words"))
    licence = whole.unionByName(missing).unionByName(other)
    licence = licence.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(PLACED - 1)))).withColumn(
        "i", F.pmod(F.xxhash64("words", "copy"), F.lit(max(1, none_rows))) + 1)
    before = F.when(F.col("copy") % 3 != 1, F.col("around")).otherwise(F.array().cast("array<string>"))
    after = F.when(F.col("copy") % 3 != 0, F.col("around")).otherwise(F.array().cast("array<string>"))
    inside = licence.join(plain.withColumnRenamed("words", "around"), "i").select(
        "template", "family", F.concat(before, "words", after).alias("words"))
    licence = licence.filter("copy = 0")
    return licence.select("template", "family", "words", F.lit(True).alias("bare")).unionByName(
        inside.withColumn("bare", F.lit(False))).unionByName(
        plain.select(F.lit(-1).alias("template"), F.lit("none").alias("family"), "words", F.lit(False).alias("bare")))


def kept_aside() -> list[int]:
    """The last template of each family that has several."""
    families = [f for f, _ in TEMPLATES]
    return [i for i, f in enumerate(families) if families.count(f) > 1 and f not in families[i + 1:]]


def _by_hash():
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64("words"), "words")  # over a bounded sample


def train(docs: DataFrame, none_rows: int = NONE_ROWS) -> tuple[DataFrame, list[str], list[float], float]:
    """(weights(feature, w), families, intercepts, temperature)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = stored(training_rows(docs, none_rows).select(
        "family", "bare", F.transform(features(F.col("words")), lambda x: x.cast("string")).alias("grams"),
        F.when(F.col("template") >= 0, F.col("template").isin(kept_aside())).otherwise(
            F.pmod(F.xxhash64("family", "words"), F.lit(5)) == 4).alias("aside")).repartition(4), "licence-training")
    indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    # Only n-grams of the licence rows themselves: any other speaks for ``none`` by its absence.
    # They are bounded by the templates.
    own = [r["gram"] for r in rows.filter("bare").select(F.explode("grams").alias("gram")).distinct().orderBy("gram").collect()]
    vectors = CountVectorizerModel.from_vocabulary(own, inputCol="grams", outputCol="features").setBinary(True)
    ready = indexer.transform(vectors.transform(rows)).select("features", "label", "aside").cache()  # the bounded sample
    fit = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False).fit
    unseen, model = fit(ready.filter(~F.col("aside"))), fit(ready)
    families = indexer.labels
    matrix, intercepts = model.coefficientMatrix, [float(x) for x in model.interceptVector]
    columns = zip(*(list(r) for r in matrix.toArray()))
    weights = [(int(g), [float(x) for x in w]) for g, w in zip(vectors.vocabulary, columns) if any(w)]
    table = _weights(docs.sparkSession, weights)
    aside = unseen.transform(ready.filter("aside")).select("label", vector_to_array("rawPrediction").alias("raw"))
    tried = [0.25 * 1.2 ** i for i in range(20)]
    losses = aside.agg(*[F.avg(_loss(F.col("raw"), F.col("label"), t)).alias(f"t{i}") for i, t in enumerate(tried)]).first()
    ready.unpersist()
    temperature = min((loss, t) for loss, t in zip(losses, tried))[1] if losses and losses[0] is not None else 1.0
    return table, families, intercepts, temperature


def _weights(spark: SparkSession, weights: list[tuple[int, list[float]]]) -> DataFrame:
    text = json.dumps([{"feature": str(g), "w": w} for g, w in weights])
    rows = F.from_json(F.lit(text), "array<struct<feature:string,w:array<double>>>")
    return spark.range(1).select(F.inline(rows)).select(F.col("feature").cast("long"), "w")


def _loss(raw, label, t: float) -> F.Column:
    top = F.array_max(raw)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))
    return F.log(total) - (F.element_at(raw, label.cast("int") + 1) - top) / t


def scan(docs: DataFrame, none_rows: int = NONE_ROWS) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed, text of every licence statement."""
    docs = docs.select("doc_id", "text")
    weights, families, intercepts, temperature = train(docs, none_rows)
    lines = paragraphs(docs)
    # Empty pieces stand at the ends only and have no weight. The outer forms keep the
    # optimizer from splitting every text again for an inferred filter.
    grams = lines.select(*KEY, F.split(F.lower(F.col("text")), WORD).alias("words")).select(
        *KEY, F.transform("words", lambda x: F.xxhash64(x)).alias("hs"))
    grams = grams.select(*KEY, "hs", F.posexplode_outer("hs").alias("pos", "h"))
    grams = grams.select(*KEY, F.explode_outer(F.array(
        F.col("h"), F.xxhash64("h", F.get("hs", F.col("pos") + 1)))).alias("feature"))
    # A gram counts once per paragraph: partial aggregates drop repeats before the sums.
    hits = grams.join(F.broadcast(weights), "feature").select(*KEY, "feature", "w").distinct()
    sums = hits.groupBy(*KEY).agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(families))])
    raw = F.array(*[F.col(f"s{i}") + F.lit(b) for i, b in enumerate(intercepts)])
    sums = sums.select(*KEY, raw.alias("raw")).withColumn("top", F.array_max("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("top")) / temperature))
    names = F.array(*[F.lit(f) for f in families])
    best = sums.select(*KEY, F.element_at(names, F.array_position("raw", F.col("top")).cast("int")).alias("best"),
                       (1 / total).alias("probability"))
    best = best.filter("best <> 'none'").withColumn(
        "family", F.when(F.col("probability") >= CERTAIN, F.col("best")).otherwise(F.lit("unknown")))
    best = stored(best.select(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole"), F.col("paragraph").alias("_paragraph"), "family", "probability"), "licences")
    if best.count() <= BROADCAST_ROWS:  # narrow rows of a counted table; beyond the bound the join shuffles
        best = F.broadcast(best)
    found = lines.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("whole") == F.col("_whole"))
                       & (F.col("paragraph") == F.col("_paragraph"))).drop("_id", "_whole", "_paragraph")
    own = templates(docs.sparkSession).groupBy(F.col("family").alias("_family")).agg(F.collect_list("grams").alias("known"))
    found = found.join(F.broadcast(own), found["family"] == F.col("_family"), "left").withColumn("grams", shingles(words(F.col("text"))))
    share = F.transform("known", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))
    similarity = F.coalesce(F.array_max(share), F.lit(0.0))
    return found.distinct().select("doc_id", "paragraph", "family", "probability", similarity.alias("similarity"),
                                   (similarity >= SIMILAR).alias("confirmed"), "text")
