"""Licence scan with a trained paragraph classifier.

Paragraphs are passages: comment marks are taken off, hard-wrapped lines joined until a sentence ends, and
long lines cut into sentences. Their words, with version numbers masked, give n-grams (1 to 3 words)
around licence cues, which a sparse multinomial logistic regression maps to a licence family. It is
trained here, on written notices of each family with words dropped, joined and set into prose, against an
unknown class made of other uses of the cue words and of a bounded sample of the corpus's own passages
(`NEGATIVES`, by hash order over all of them). A temperature fitted on held-out variants calibrates the
probabilities; every family of `MIN_PROBABILITY` or more is a candidate, so a dual licence has two.

A candidate is confirmed by template comparison: the passage holds word pairs that only this family's
templates have, and shares enough of all its pairs with one of them. Then its version and modifiers are
read from the passage itself: `gpl-2.0+` (or any later), `lgpl-2.1`, `cc-by-nc-sa-4.0`; a family
without a stated version stays `gpl`. What the text contradicts (a Lesser licence taken for the General one, a version that
the family never had) is unknown.

The vocabulary holds only n-grams with a cue, so a passage without a cue has an empty vector and
is unknown by construction: the search for cues is an exact filter, and only passages that pass
it are vectorised. One narrow pass over the texts; the result is joined by document key.

Defined cases: null or blank texts have no paragraphs and no family; equal rows get equal results; an
empty table trains on the notices alone and gives no rows; columns other than id and text are not read.
`n_paragraphs` counts lines with text, `n_cued` the passages with a cue.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.exprs import let
from ionloom.llm.common import KEY, key_columns
from ionloom.session import stage

NEGATIVES = 2000
SAMPLE_MARGIN = 4
VARIANTS = 24
MIN_PROBABILITY = 0.05
MIN_OVERLAP = 0.5
MAX_TERMS = 20_000
UNKNOWN = "unknown"

#: Notices and template openings by family; version numbers are masked when they are compared.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
        "This product includes software developed by the Apache Software Foundation. Apache Software License, Version 1.1.",
        "Unless required by applicable law or agreed to in writing, software distributed under the Apache License is distributed on an as is basis",
    ],
    "mit": [
        "Released under the MIT License.", "This software is distributed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "isc": [
        "Released under the ISC License.", "SPDX-License-Identifier: ISC", "SPDX: ISC", "Licensed under the terms of the ISC licence.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3 license.", "Distributed under GPLv3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the terms of the GNU GPL.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.", "Distributed under LGPLv2.1+.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the GNU Library General Public License, version 2.", "Licensed under the LGPL, version 2.1.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPLv3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 2-clause BSD license.", "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0", "Licensed under the MPL 2.0.",
    ],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Made available under the terms of the Eclipse Public License v1.0."],
    "zlib": ["Released under the zlib license.", "SPDX-License-Identifier: Zlib", "Licensed under the zlib/libpng license."],
    "bsl": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "cc": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 3.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense",
    ],
    "all-rights-reserved": ["Copyright, all rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}
#: What the text of a family must say, and what it must not.
NAMED = {
    "apache": (r"\bapache\b", None), "mit": (r"\bmit\b|permission is hereby granted,? free of charge|this permission notice shall", None),
    "isc": (r"\bisc\b|permission to use,? copy,? modify", None), "gpl": (r"\bgpl\b|general public license", r"\blesser\b|library general|affero|\blgpl\b|\bagpl\b"),
    "lgpl": (r"\blgpl\b|lesser general|library general", r"affero|\bagpl\b"), "agpl": (r"affero|\bagpl\b", None),
    "bsd": (r"\bbsd\b|redistribution and use|redistributions of source", None), "mpl": (r"mozilla public|\bmpl\b", None), "epl": (r"eclipse public|\bepl\b", None),
    "zlib": (r"\bzlib\b", None), "bsl": (r"\bboost software|\bbsl\b", None),
    "cc": (r"creative commons.*attribution|\bcc[ -]by\b", None), "public-domain": (r"public domain|\bcc0\b|\bunlicense\b", None),
    "all-rights-reserved": (r"rights reserved", None),
}
#: Versions that a family had; a passage may state none.
VERSIONS = {
    "apache": ["1.0", "1.1", "2.0"], "gpl": ["1.0", "2.0", "3.0"], "lgpl": ["2.0", "2.1", "3.0"], "agpl": ["1.0", "3.0"], "mpl": ["1.0", "1.1", "2.0"],
    "epl": ["1.0", "2.0"], "bsl": ["1.0"], "cc": ["1.0", "2.0", "2.5", "3.0", "4.0"],
}
LATER = r"or \(?at your option\)?,? ?any later|or any later|or later|-or-later|version \d(?:\.\d)?\+"
OTHER_USES = [
    "The driver showed a license and the plate number.", "A fishing license is required near the lake.", "She lost her license after the accident.",
    "The pilot license was renewed in March.", "Permission to enter was refused.", "They asked for permission before they took the picture.",
    "The copyright office is closed on Monday.", "A lecture on copyright law and its history.", "No warranty covers water damage.",
    "The car came with a warranty of five years.", "The public was admitted to the garden.", "A general met the public in the square.",
    "The Apache helicopter landed near the village.", "The mit of the glove was torn.", "They license music to broadcasters.",
    "Poetic license allows such a rhyme.", "A gnu grazed beside the zebra.", "The commons voted on the creative budget.",
    "The version of the story that she told was different.", "Redistribution of land followed the reform.", "The licensed premises close at eleven.",
    "Attribution of the painting is disputed.", "He read the terms of the contract twice.", "The agency may license a product for export.",
]
#: Every word of a term's neighbourhood that makes it a cue.
CUES = (
    "license licensed licenses sublicense copyright copyrighted permission permitted warranty redistribute redistribution redistributions "
    "apache gnu gpl lgpl agpl bsd isc zlib mozilla mpl eclipse epl bsl boost spdx cc cc0 creativecommons commons copyleft unlicense unencumbered "
    "domain rights reserved"
).split()
#: The same in a text as it is written: British spelling, versions glued to the name.
CUE = rf"(?i)(?:^|[^a-z0-9])(?:{'|'.join(CUES)}|(?:sub)?licen[cs]e[ds]?|[al]?gplv)(?![a-z])"
COMMENT = r"(?m)^[ \t]*(?://+|/\*+|\*+/|\*+(?=\s)|#+(?=\s)|;+(?=\s)|--+(?=\s)|%+(?=\s)|<!--)[ \t]*"
#: A line of 1,000 characters or more is a paragraph of its own, not one that was wrapped.
WRAP = r"([^.!?\s])[ \t]*\r?\n(?<![^\n]{1000}\n)(?=[ \t]*\S)"
SENTENCE = r"\n|(?<=[.!?])[ \t]+(?=\p{Lu})"


def passages(text: Column) -> Column:
    """Sentences of a text whose hard-wrapped lines are joined."""
    return F.split(F.regexp_replace(F.regexp_replace(text, COMMENT, ""), WRAP, "$1 "), SENTENCE)


def spelled(text: Column) -> Column:
    """Small letters, one spelling of licence, versions apart from names and after the word `version`."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"licenc", "licens"), r"\s+", " ")
    t = F.regexp_replace(t, r"\b([la]?gpl|apache|mpl|epl|bsl)[ ,-]*(?:version|v\.?)? ?(?=\d)", "$1 version ")
    return F.regexp_replace(t, r"\bv(?:er)?\.? ?(?=\d)", "version ")


def paragraph_words(text: Column) -> Column:
    masked = F.regexp_replace(spelled(text), r"\d+(?:\.\d+)*\+?", "#")
    return F.array_remove(F.split(masked, r"[^\p{L}0-9#]+"), "")


def terms(words: Column) -> Column:
    """Word n-grams of one to three words that hold a cue."""
    cue = rf"(?:^| )(?:{'|'.join(CUES)})[0-9.]*(?: |$)"

    def grams(w: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))

    # The words are computed once, not for every n-gram.
    return let(words, lambda w: F.filter(F.concat(w, grams(w, 2), grams(w, 3)), lambda g: g.rlike(cue)))


def rows_of(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("notice")) for a, b in rows))
    return spark.range(1, numPartitions=1).select(F.inline(pairs))


def notices(spark: SparkSession) -> DataFrame:
    return rows_of(spark, [(family, text) for family, texts in NOTICES.items() for text in texts])


def word_pairs(words: Column) -> Column:
    def pairs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, 2), " ")))

    return let(words, pairs)


def unlike_notices(sample: DataFrame) -> DataFrame:
    """Passages that share few n-grams with a cue with any notice: the sample may hold real notices, also amid
    prose, which aren't unknown."""
    spark = sample.sparkSession
    all_terms = notices(spark).agg(F.array_distinct(F.flatten(F.collect_list(terms(paragraph_words(F.col("notice")))))).alias("all"))
    mine = F.array_distinct(terms(paragraph_words(F.col("paragraph"))))
    shared = F.coalesce(F.size(F.array_intersect(mine, F.col("all"))) / F.nullif(F.size(mine), F.lit(0)), F.lit(0.0))
    # One row, of a size that NOTICES fixes.
    return sample.repartition(16).crossJoin(F.broadcast(all_terms)).filter(shared < MIN_OVERLAP / 2).select("paragraph")


def training_rows(spark: SparkSession, sample: DataFrame) -> DataFrame:
    """(family, words, held): variants of the notices and other uses, and sampled paragraphs."""
    known = notices(spark).unionByName(rows_of(spark, [(UNKNOWN, t) for t in OTHER_USES]))
    spread = known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("w", paragraph_words(F.col("notice")))
    # Variant 0 is whole; the others lose words by hash, a tenth of them at first and up to a third.
    drop = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("v"), F.col("notice")), F.lit(100)) >= F.when(F.col("v") == 0, 0).otherwise(8 + F.col("v"))
    thinned = spread.withColumn("words", F.filter("w", drop))
    prose = sample.select(paragraph_words(F.col("paragraph")).alias("p")).withColumn("n", F.pmod(F.xxhash64("p"), F.lit(VARIANTS)))
    around = prose.groupBy("n").agg(F.min("p").alias("p"))
    mixed = thinned.join(around, (F.col("v") == F.col("n")) & (F.col("v") % 3 == 1), "left")
    words = F.when(F.col("p").isNotNull(), F.concat(F.slice("p", 1, 6), "words", F.slice("p", 7, 8))).otherwise(F.col("words"))
    held = F.pmod(F.xxhash64("notice", "v"), F.lit(4)) == 0
    variants = mixed.select("family", words.alias("words"), held.alias("held"))
    negatives = prose.select(F.lit(UNKNOWN).alias("family"), F.col("p").alias("words"), (F.pmod(F.xxhash64("p", F.lit(3)), F.lit(4)) == 0).alias("held"))
    return variants.unionByName(negatives).filter(F.size("words") > 0).withColumn("terms", terms(F.col("words")))


class Classifier:
    """Vocabulary, regression and temperature; `classify` adds `candidates` (family, probability) to rows with `terms`."""

    def __init__(self, vectorizer: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], temperature: float) -> None:
        self.model = PipelineModel([vectorizer, regression])
        self.families, self.temperature = families, temperature

    def classify(self, df: DataFrame) -> DataFrame:
        raw = vector_to_array("margins")
        scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / self.temperature))
        scored = self.model.transform(df).withColumn("_s", scaled)
        total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
        names = F.array(*(F.lit(f) for f in self.families))
        chances = F.zip_with(names, "_s", lambda f, x: F.struct(f.alias("family"), (x / F.col("_t")).alias("probability")))
        likely = F.filter("_c", lambda c: (c["probability"] >= MIN_PROBABILITY) & (c["family"] != UNKNOWN))
        none = F.array(F.struct(F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("probability")))
        out = scored.withColumn("_t", total).withColumn("_c", chances)
        return out.withColumn("candidates", F.when(F.size(likely) > 0, likely).otherwise(none)).drop("features", "margins", "_p", "_y", "_s", "_t", "_c")


def train(spark: SparkSession, paragraphs: DataFrame, negatives: int = NEGATIVES) -> Classifier:
    """`paragraphs`: a column `paragraph`; at most `negatives` of them are used, the first by hash."""
    ordered = paragraphs.select("paragraph", F.pmod(F.xxhash64("paragraph"), F.lit(1 << 30)).alias("h")).orderBy("h", "paragraph").limit(negatives)
    sample = stage(unlike_notices(stage(ordered.select("paragraph"), "sample")), "negatives")
    rows = stage(training_rows(spark, sample), "training")
    families = [UNKNOWN, *NOTICES]
    names = F.array(*(F.lit(f) for f in families))
    rows = rows.withColumn("label", (F.array_position(names, F.col("family")) - 1).cast("double")).coalesce(1).cache()
    fit = rows.filter(~F.col("held"))
    vectorizer = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=MAX_TERMS, binary=True).fit(fit)
    regression = LogisticRegression(
        featuresCol="features", labelCol="label", rawPredictionCol="margins", probabilityCol="_p", predictionCol="_y",
        family="multinomial", regParam=0.002, elasticNetParam=0.0, maxIter=40,
    ).fit(vectorizer.transform(fit))
    margins = vector_to_array("margins")
    held = regression.transform(vectorizer.transform(rows.filter("held"))).select(margins.alias("m"), F.col("label").cast("int").alias("y"))

    def loss(t: float) -> Column:
        top = F.array_max("m")
        norm = F.log(F.aggregate(F.transform("m", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x))
        return F.avg(norm - (F.element_at("m", F.col("y") + 1) - top) / t)

    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    losses = held.agg(*(loss(t).alias(str(i)) for i, t in enumerate(grid))).first()
    rows.unpersist()
    known = [x for x in losses if x is not None]
    return Classifier(vectorizer, regression, families, grid[list(losses).index(min(known))] if known else 1.0)


def templates(spark: SparkSession) -> DataFrame:
    """(family, templates, own, must, must_not, versions): the word pairs of each notice, those that no other
    family's notices have, and what confirms the family in a text."""
    pairs = notices(spark).select("family", word_pairs(paragraph_words(F.col("notice"))).alias("n"))
    single = pairs.select("family", F.explode("n").alias("g")).groupBy("g").agg(F.min("family").alias("family"), F.max("family").alias("other"))
    own = single.filter(F.col("family") == F.col("other")).groupBy("family").agg(F.collect_set("g").alias("own"))
    facts = [(f, must, must_not, VERSIONS.get(f)) for f, (must, must_not) in NAMED.items()]
    rules = spark.createDataFrame(facts, "family string, must string, must_not string, versions array<string>")
    return pairs.groupBy("family").agg(F.collect_list("n").alias("templates")).join(own, "family").join(rules, "family")


def stated_version(family: Column, text: Column) -> Column:
    """Version that a spelled passage states, as `2.0`; NULL for none."""
    after = F.regexp_extract(text, r"version (\d+(?:\.\d+)?)", 1)
    after = F.when(after != "", after).otherwise(F.regexp_extract(text, r"license,? (\d+(?:\.\d+)?)", 1))
    number = F.when(family == "cc", F.regexp_extract(text, r"\b(\d\.\d)\b", 1)).otherwise(after)
    return F.when(number.rlike(r"\."), number).when(number != "", F.concat(number, F.lit(".0")))


def licence_name(family: Column, text: Column) -> Column:
    """The family with its modifiers and version; NULL where the passage contradicts it (by `must`, `must_not`, `versions`)."""
    version = stated_version(family, text)
    says = F.rlike(text, F.col("must")) & ~F.coalesce(F.rlike(text, F.col("must_not")), F.lit(False))
    had = F.when(F.col("versions").isNotNull() & version.isNotNull(), F.array_contains("versions", version))

    def part(pattern: str, value: str) -> Column:
        return F.when(text.rlike(pattern), value).otherwise("")

    commons = F.concat(
        F.lit("cc-by"), part(r"\bnc\b|non-?commercial", "-nc"), part(r"\bsa\b|share-?alike", "-sa"), part(r"\bnd\b|no-?deriv", "-nd")
    )
    clause = F.regexp_extract(text, r"(\d)-clause", 1)
    base = F.when(family == "cc", commons).when((family == "bsd") & (clause != ""), F.concat(F.lit("bsd-"), clause, F.lit("-clause"))).otherwise(family)
    named = F.when(had.isNotNull(), F.concat_ws("-", base, version)).otherwise(base)
    later = family.isin("gpl", "lgpl", "agpl") & version.isNotNull() & text.rlike(LATER)
    return F.when(says & F.coalesce(had, F.lit(True)), F.concat(named, F.when(later, "+").otherwise("")))


def confirmed(candidates: DataFrame) -> DataFrame:
    """`overlap`: the largest share of a template's word pairs, or of the passage's, that both have; `licence`:
    the name, where the family is confirmed."""
    known = templates(candidates.sparkSession)
    mine = candidates.withColumn("g", word_pairs(F.col("words")))
    joined = mine.join(F.broadcast(known), "family", "left")  # a row per family: bounded by NOTICES
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("g"))) / F.least(F.size(t), F.size("g"))))
    distinct = F.coalesce(F.arrays_overlap("own", "g"), F.lit(False))
    out = joined.withColumns({"overlap": F.coalesce(share, F.lit(0.0)), "spelled": spelled(F.col("paragraph"))})
    sure = (F.col("overlap") >= MIN_OVERLAP) & distinct
    named = F.when(sure, licence_name(F.col("family"), F.col("spelled")))
    return out.withColumn("licence", named).drop("templates", "own", "must", "must_not", "versions", "spelled", "g")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """(id, keys, at, paragraph, family, probability, overlap) of every passage with a cue, a row for each licence that
    is confirmed; passages without one are a row of the unknown family."""
    spark = docs.sparkSession
    texts = docs.select(id_column, F.col(text_column).alias("text"), *key_columns(id_column, text_column))
    if classifier is None:
        lines = texts.select(F.explode(passages(F.col("text"))).alias("paragraph")).filter(F.trim("paragraph") != "")
        # The sample is the first passages by hash; a bound on the hash keeps what is sorted for it small at any size.
        share = min(1.0, SAMPLE_MARGIN * NEGATIVES / max(docs.count(), 1))
        classifier = train(spark, lines.filter(F.pmod(F.xxhash64("paragraph"), F.lit(1 << 30)) <= int(share * (1 << 30))))
    cued = texts.filter(F.col("text").rlike(CUE)).select(id_column, *KEY, F.posexplode(passages(F.col("text"))).alias("at", "paragraph"))
    words = cued.filter(F.col("paragraph").rlike(CUE)).withColumn("words", paragraph_words(F.col("paragraph")))
    scored = classifier.classify(words.withColumn("terms", terms(F.col("words"))))
    candidates = scored.select(id_column, *KEY, "at", "paragraph", "words", F.explode("candidates").alias("c")).select("*", "c.family", "c.probability")
    found = confirmed(candidates.drop("c"))
    sure = F.col("licence").isNotNull()
    names = F.when(sure, F.struct(F.col("licence").alias("family"), "probability", "overlap"))
    grouped = found.groupBy(id_column, *KEY, "at", "paragraph").agg(F.collect_set(names).alias("n"), F.max("overlap").alias("best"))
    none = F.array(F.struct(F.lit(UNKNOWN).alias("family"), F.lit(None).cast("double").alias("probability"), F.col("best").alias("overlap")))
    each = grouped.withColumn("c", F.explode(F.when(F.size("n") > 0, F.col("n")).otherwise(none)))
    return each.select(id_column, *KEY, "at", "paragraph", "c.family", "c.probability", "c.overlap")


def document_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_paragraphs, n_cued, n_licensed, families (sorted, comma-joined) and least probability of every row."""
    keyed = docs.select(id_column, F.col(text_column).alias("text"), *key_columns(id_column, text_column))
    known = F.col("family") != UNKNOWN
    found = scan(docs, id_column, text_column).groupBy(*KEY).agg(
        F.count_distinct("at").alias("n_cued"), F.count_distinct(F.when(known, F.col("at"))).alias("n_licensed"),
        F.sort_array(F.collect_set(F.when(known, F.col("family")))).alias("f"), F.min("probability").alias("probability"),
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return keyed.select(id_column, *KEY, F.size(lines).cast("long").alias("n_paragraphs")).join(found, KEY, "left").select(
        id_column, "n_paragraphs", zero("n_cued"), zero("n_licensed"),
        F.coalesce(F.array_join("f", ","), F.lit("")).alias("families"), F.round("probability", 6).alias("probability"),
    )
