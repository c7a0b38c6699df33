"""Licence statements in documents, found by a trained paragraph classifier; all of it DataFrame operations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.common import step, table

SAMPLED_DOCS = 600
SAMPLED_PARAGRAPHS = 3000
# the bounded training rows are few; a gradient comes back from each of these parts in every round
TRAINING_PARTS = 4
CONFIRMED = 0.6
UNKNOWN = "unknown"

# How each family is usually stated; digits stand for any version or year.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL v3", "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "isc": ["Licensed under the ISC License", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "Licensed under the LGPL v2.1", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0",
    ],
}
# Words and pairs that name a family and no other: families share most of their wording, so a second one must be named.
TELLING = {
    "agpl": ["affero", "agpl"], "apache": ["apache"], "bsd": ["bsd", "binary forms"], "cc-by": ["by 0", "attribution 0"],
    "cc-by-nc": ["by nc", "attribution noncommercial"], "cc-by-sa": ["by sa", "attribution sharealike"],
    "cc0": ["cc0", "waived all"], "gpl": ["gnu general", "gpl"], "isc": ["isc"], "lgpl": ["lesser general", "lgpl"],
    "mit": ["mit", "hereby granted"], "mpl": ["mozilla", "mpl"],
}
PIECE_LINES = 1000
# Words that say nothing about licences.
COMMON = frozenset("0 code copy form forms has a all and any are as at by can following for in is it may of or provided person possible published related subject that the this to under use version with work you".split())
# Sentences with the same words that state no licence of these families.
OTHERWISE = [
    "He lost his driving license and had to pay a fine", "The hotel holds a license to sell wine",
    "A license plate was found near the road", "The general public was invited to the museum",
    "The apache helicopter flew over the river", "Students at MIT released a report under pressure",
    "The work is subject to the terms of the contract", "All rights reserved", "Licensed under a private agreement with the owner",
    "Released under the cover of night", "A creative commons for artists opened in the old mill",
    "The license of this station was not renewed", "See the license file for the terms", "Licensed under the Example License, Version 1.0",
]


def words(text: Column) -> Column:
    """Lower-case words and numbers; every number reads 0, so that versions and years do not matter."""
    plain = F.regexp_replace(F.lower(text), r"[0-9]+", "0")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, text, words)``: the lines of each text that hold a word, numbered from 0."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "text"))
    return lines.withColumn("words", words(F.col("text"))).filter(F.size("words") > 0)


def _grams() -> PipelineModel:
    return PipelineModel([NGram(n=2, inputCol="words", outputCol="pairs"), NGram(n=3, inputCol="words", outputCol="triples")])


def _vocabulary() -> list[str]:
    """The words, pairs and triples of the statements and of the sentences that only sound like them: what else a
    paragraph says tells nothing about licences.
    """
    texts = [*OTHERWISE, *(t for some in TEMPLATES.values() for t in some)]
    return sorted({" ".join(g) for t in texts for n in (1, 2, 3) for g in _runs(t, n)})


def features(df: DataFrame) -> DataFrame:
    grams = _grams().transform(df).withColumn("grams", F.concat("words", "pairs", "triples"))
    counted = CountVectorizerModel.from_vocabulary(_vocabulary(), inputCol="grams", outputCol="features").setBinary(True)
    return counted.transform(grams).drop("grams", "triples")


@dataclass(frozen=True)
class Model:
    families: LogisticRegressionModel
    names: list[str]
    known: LogisticRegressionModel


def _literal_rows(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in pairs))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _margin(df: DataFrame, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    """The most likely family and by how much it is likelier than none, as the one feature of the calibration."""
    from pyspark.ml.feature import VectorAssembler

    scored = model.transform(df).withColumn("raw", vector_to_array("rawPrediction"))
    own = F.slice("raw", 1, len(names) - 1)
    scored = scored.withColumn("best", F.array_max(own)).withColumn("margin", F.col("best") - F.element_at("raw", len(names)))
    family = F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(own, F.col("best")).cast("int"))
    scored = scored.withColumn("family", family).drop("rawPrediction", "probability", "prediction", "raw", "best")
    return VectorAssembler(inputCols=["margin"], outputCol="margins").transform(scored)


def train(docs: DataFrame, sampled_docs: int = SAMPLED_DOCS, sampled_paragraphs: int = SAMPLED_PARAGRAPHS) -> Model:
    """Fit family weights and the calibration of the unknown class.

    Statements are the ``TEMPLATES``, as they stand and behind words of sampled paragraphs; unknown are ``OTHERWISE`` and sampled
    paragraphs that hold no three words in a row of a template. (Words ahead of a statement are the first 200 characters of a
    sampled paragraph.) The sample is bounded: paragraphs of the ``sampled_docs``
    documents of the least hash of their id, ``sampled_paragraphs`` of them. One in four rows is kept back from
    the weights and fits the calibration: the probability that a paragraph states any family, given how
    much likelier the best family is than none. No documents are needed.
    """
    spark = docs.sparkSession
    names = [*sorted(TEMPLATES), UNKNOWN]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sampled_docs)
    sample = paragraphs(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    sample = sample.select("text", F.xxhash64("doc_id", "paragraph").alias("key")).orderBy("key", "text").limit(sampled_paragraphs)

    statements = [(f, t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    alone = _literal_rows(spark, statements * 2 + [(UNKNOWN, t) for t in OTHERWISE * 4])
    choice = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in statements))
    told = F.element_at(choice, (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(len(statements))) + 1).cast("int"))
    start = F.substring("text", 1, 200)
    with_statement = sample.select(told["family"].alias("family"), F.concat_ws(" ", start, told["text"]).alias("text"))
    triples = F.array(*(F.lit(" ".join(g)) for g in sorted({g for _, t in statements for g in _runs(t, 3)})))
    plain = sample.select(F.lit(UNKNOWN).alias("family"), "text")
    rows = alone.union(with_statement).union(plain).withColumn("words", words(F.col("text")))
    rows = NGram(n=3, inputCol="words", outputCol="seen").transform(rows)
    rows = rows.filter((F.col("family") != UNKNOWN) | ~F.arrays_overlap("seen", triples) | F.col("text").isin(OTHERWISE)).drop("seen")
    label = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("family")) - 1
    rows = rows.select(label.cast("double").alias("label"), "words", (F.pmod(F.xxhash64("text", F.lit(2)), F.lit(4)) == 0).alias("held"))
    rows = features(step(rows, "licence-rows").coalesce(TRAINING_PARTS))
    fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, featuresCol="features", labelCol="label")
    families = fit.fit(rows.filter("not held"))
    calibrate = _margin(rows.filter("held"), families, names)
    calibrate = calibrate.select("margins", (F.col("label") < len(names) - 1).cast("double").alias("known"))
    known = LogisticRegression(featuresCol="margins", labelCol="known", regParam=1e-4, maxIter=50).fit(calibrate)
    return Model(families, names, known)


def _plain_words(text: str) -> list[str]:
    """The words of a template, as ``words`` cuts them; templates are ASCII."""
    return [x for x in re.split(r"[^a-z0-9]+", re.sub(r"[0-9]+", "0", text.lower())) if x]


def _runs(text: str, n: int) -> set[tuple[str, ...]]:
    """The runs of ``n`` words of a template."""
    w = _plain_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _likeness(pairs: Column, family: Column) -> Column:
    """The largest share of a template's pairs of words that the paragraph has, over the family's templates."""
    out = F.lit(0.0)
    for name in sorted(TEMPLATES):
        shares = []
        for template in TEMPLATES[name]:
            runs = sorted(_runs(template, 2))
            if runs:
                literal = F.array(*(F.lit(" ".join(r)) for r in runs))
                shares.append(F.size(F.array_intersect(literal, pairs)) / F.lit(float(len(runs))))
        best = F.greatest(*shares) if len(shares) > 1 else shares[0]
        out = F.when(family == name, best).otherwise(out)
    return out


def _keys(confirmed: float) -> list[str]:
    """Words of which every text has one that holds the share ``confirmed`` of the pairs of any template."""
    keys: set[str] = set()
    for template in sorted(t for some in TEMPLATES.values() for t in some):
        runs = _runs(template, 2)
        rest = sorted({w for run in runs for w in run}, key=lambda w: (w in COMMON, -sum(w in run for run in runs), w))
        for w in rest:
            if sum(not keys & set(run) for run in runs) < confirmed * len(runs):
                break
            keys.add(w)
    return sorted(keys)


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _last(w: Column, n: int) -> Column:
    return F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n))


def _breaks(docs: DataFrame, confirmed: float) -> DataFrame:
    """``(doc_id, paragraph, own, after, before, words)`` around every line break in running text at which a statement can be wrapped.

    ``own`` is the line before the break, ``after`` the lines behind it and ``before`` those ahead of it up to lines without
    words, as far as the longest template goes; ``words`` are those of the end of ``own`` and of ``after``.
    """
    longest = max(len(_plain_words(t)) for some in TEMPLATES.values() for t in some)
    keys = _keys(confirmed)
    text = F.col("text").cast("string")
    texts = docs.filter(text.contains("\n") & F.lower(text).rlike("|".join(re.sub("0", "[0-9]+", k) for k in keys))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.split(text, "\n").alias("all")
    )
    # a long text goes on in pieces of so many breaks, each with the lines around them that a statement may reach
    piece = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 2) / PIECE_LINES).cast("int")), lambda c: F.struct(
        (c * PIECE_LINES).alias("first"), F.least(c * PIECE_LINES, F.lit(longest)).alias("skip"),
        F.slice("all", F.greatest(c * PIECE_LINES - longest, F.lit(0)) + 1, F.least(c * PIECE_LINES, F.lit(longest)) + PIECE_LINES + longest).alias("lines"),
    ))
    # outer forms, since plain ones would be filtered ahead, for which all pieces would be made again
    pieces = texts.select("doc_id", F.explode_outer(piece).alias("p")).filter("p is not null")
    lines = pieces.select("doc_id", "p.first", "p.skip", F.transform("p.lines", words).alias("lines"))
    literal = F.array(*(F.lit(k) for k in keys))
    lines = lines.withColumn("keyed", F.transform("lines", lambda w: F.arrays_overlap(w, literal)))

    def around(i: Column) -> Column:
        after = F.slice("lines", i + 2, F.lit(longest))
        end = F.array_position(F.transform(after, F.size), 0).cast("int")
        after = F.when(end > 0, F.slice(after, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(after)
        first = F.greatest(i - longest + 1, F.lit(1))
        before = F.reverse(F.slice("lines", first, i + 1 - first))
        stop = F.array_position(F.transform(before, F.size), 0).cast("int")
        before = F.when(stop > 0, F.slice(before, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(before)
        own = F.element_at("lines", i + 1)
        seen = F.concat(_last(own, longest), F.slice(F.flatten(after), F.lit(1), F.lit(longest)))
        return F.struct(
            (F.col("first") + i - F.col("skip")).alias("paragraph"), own.alias("own"), after.alias("after"), _last(F.flatten(F.reverse(before)), longest).alias("before"), seen.alias("words")
        )

    last = F.least(F.col("skip") + PIECE_LINES - 1, F.size("lines") - 2)
    # most breaks have no key in reach, which is told by a flag a line
    near = F.filter(F.sequence(F.col("skip"), last), lambda i: F.array_contains(F.slice("keyed", i + 1, F.lit(longest + 1)), True))
    found = F.transform(near, around)
    found = F.filter(found, lambda x: (F.size(x["own"]) > 0) & (F.size(x["after"]) > 0) & F.arrays_overlap(x["words"], literal))
    return lines.select("doc_id", F.inline_outer(found)).filter("paragraph is not null").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def _stated(df: DataFrame, model: Model) -> DataFrame:
    """A row for every family that is likely to be stated, with its ``chance`` and whether it is the likeliest."""
    scored = model.families.transform(features(df)).withColumn("raw", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")
    n = len(model.names) - 1
    own, none = F.slice("raw", 1, n), F.element_at("raw", n + 1)
    slope, base = float(model.known.coefficients[0]), float(model.known.intercept)
    scored = scored.filter(slope * (F.array_max(own) - none) + base >= 0)
    best = F.array_position(own, F.array_max(own)) - 1
    names = F.array(*(F.lit(x) for x in model.names))
    each = F.transform(own, lambda x, i: F.struct(
        F.element_at(names, i + 1).alias("family"), (1 / (1 + F.exp(-(slope * (x - none) + base)))).alias("chance"), (i == best).alias("best"),
    ))
    return scored.withColumn("each", F.explode_outer(F.filter(each, lambda x: x["chance"] >= 0.5))).select("*", "each.*").filter("family is not null").drop("each", "raw")


def _named(df: DataFrame) -> Column:
    tells = F.lit(False)
    for name in sorted(TELLING):
        literal = F.array(*(F.lit(t) for t in TELLING[name]))
        tells = F.when(F.col("family") == name, F.arrays_overlap(literal, F.concat("words", "pairs"))).otherwise(tells)
    return tells


def scan(docs: DataFrame, model: Model, confirmed: float = CONFIRMED) -> DataFrame:
    """``(doc_id, paragraph, family, probability, likeness, confirmed)`` for every paragraph that states a known family.

    A paragraph is a line with a word in it; a statement wrapped over lines is one of the line where it starts. The
    likeliest family has a row, and so has every other that is confirmed and named (``TELLING``). ``probability`` is the calibrated chance that the
    paragraph states the family (at least 0.5; others are of the unknown class and give no row); ``likeness`` is
    the largest share of the word pairs of one of the family's templates found in it, and confirms the
    prediction from ``confirmed`` on. Null and empty texts have no paragraph; rows without an id are scanned
    too, repeated rows each; extra columns are ignored; an empty table gives no rows.

    The scan is narrow: no shuffle, whatever the shares of sources, and only JVM operations.
    """
    lines = _stated(paragraphs(docs).drop("text"), model).withColumn("likeness", _likeness(F.col("pairs"), F.col("family")))
    lines = lines.filter(F.col("best") | ((F.col("likeness") >= confirmed) & _named(lines)))
    family = F.col("family")
    wrapped = _stated(_breaks(docs, confirmed), model).withColumn("likeness", _likeness(F.col("pairs"), family))
    wrapped = wrapped.filter((F.col("likeness") >= confirmed) & (F.col("best") | _named(wrapped)))
    # it starts in this line: no line holds it alone, without this line there is less of it, and lines before add nothing
    alone = F.exists(F.concat(F.array("own"), F.col("after")), lambda w: _likeness(_pairs(w), family) >= confirmed)
    wrapped = wrapped.filter(
        ~alone & (F.col("likeness") > _likeness(_pairs(F.flatten("after")), family))
        & (F.col("likeness") >= _likeness(_pairs(F.concat("before", "words")), family))
    )
    columns = ["doc_id", "paragraph", "family", "chance", "likeness"]
    return lines.select(*columns).union(wrapped.select(*columns)).select(
        "doc_id", "paragraph", "family", F.round("chance", 6).alias("probability"), F.round("likeness", 6).alias("likeness"),
        (F.col("likeness") >= confirmed).alias("confirmed"),
    )


def by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, licences, n_statements, n_unconfirmed)`` for every id: the confirmed families in order, and how many statements."""
    per = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("licences"),
        F.count_if("confirmed").alias("n_statements"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return ids.join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
        F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"),
    )


def op10_licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return by_document(docs, scan(docs, train(docs)))


QUERIES = {"op10_licences": op10_licences}
ORACLES: dict[str, str] = {}
