"""Licence notices by a trained paragraph classifier, confirmed against templates; DataFrame and JVM functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm.common import staged, text_of

UNKNOWN = "unknown"

# Public licence notices, by family.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "Dedicated to the public domain under CC0 1.0."),
    ("reserved", "All rights reserved."),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)

# Words that name a family. A template that holds some of them is confirmed only by text with the same ones.
_NAMES = {
    "apache": "apache",
    "mit": "mit",
    "bsd": "bsd",
    "gpl": "gnu general gpl",
    "lgpl": "gnu lesser",
    "agpl": "gnu affero",
    "mpl": "mozilla",
    "cc-by": "creative commons attribution cc by",
    "cc-by-sa": "creative commons sharealike cc by sa",
    "cc-by-nc": "creative commons noncommercial cc by nc",
    "cc0": "cc0",
    "reserved": "reserved",
}

# Words that tell a notice without a name from the notices of others that borrow its sentences.
_MARKS = {"mit": "sublicense"}

# Public notices of licences that are no family here, and sentences with the words of notices that are none.
_DECOYS = (
    "This work is licensed under the Eclipse Public License, version 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "The file is distributed under the terms of the Artistic License.",
    "The driver was asked for a license and could not find it.",
    "Permission to enter the building was granted after a long wait.",
    "Free software is a topic of many public talks.",
    "The library is open to the general public without charge.",
    "All rights of way must be observed by the drivers.",
    "The table was reserved for all guests.",
    "The work of the foundation is published in a new version each year.",
    "He used all means to distribute the copies of his work.",
    "The software is released to the public in two versions.",
    "A license is needed to sell the product under this name.",
    "The Apache helicopter is in version four now.",
    "She studied at MIT and works for a common cause.",
    "The following conditions are common in winter.",
    "Version 2.0 of the form is subject to change.",
)

# Where one line ends and the next has only blanks; a wrapped line does not end a paragraph.
_BLANK = r"(?:\r?\n[ \t]*+\r?\n|\r[ \t]*+\r)\s*+"

#: Words of a paragraph that are classified together; longer ones are read in windows that overlap by half.
WINDOW = 64


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _grams(df: DataFrame) -> DataFrame:
    """``df`` (words) with ``grams``: its words and word pairs."""
    paired = NGram(n=2, inputCol="words", outputCol="pairs").transform(df)
    return paired.withColumn("grams", F.concat("words", "pairs")).drop("pairs")


def _paragraphs(docs: DataFrame, doc_id: str, text: str, known: list[str] | None = None) -> DataFrame:
    """doc_id, paragraph (from 0), window (from 0), words: text between blank lines with words, cut into windows.

    With ``known``, only windows that hold one of these words.
    """
    blocks = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text_of(text), _BLANK)).alias("paragraph", "block"))
    cut = blocks.select("doc_id", "paragraph", words_of(F.col("block")).alias("all")).where(F.size("all") > 0)
    half = WINDOW // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("all") - WINDOW) / half).cast("int")))
    windows = F.transform(starts, lambda i: F.slice("all", i * half + 1, WINDOW))
    each = cut.select("doc_id", "paragraph", F.posexplode(windows).alias("window", "words"))
    if known is None:
        return each
    return each.where(F.arrays_overlap("words", F.array(*map(F.lit, known)).cast("array<string>")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("notice")) for f, t in TEMPLATES))
    listed = spark.range(1).select(F.inline(rows))
    return listed.select("family", words_of(F.col("notice")).alias("words"))


def _windows_of_templates(templates: DataFrame) -> DataFrame:
    """Whole notices and their runs of words from half their length on, as examples of a family."""
    n = F.size("words")
    lengths = F.sequence(F.greatest(F.lit(3), F.ceil(n / 2).cast("int")), F.greatest(F.lit(3), n))
    by_length = templates.select("family", "words", F.explode(lengths).alias("length"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.col("length") + 1)))
    return by_length.select("family", "length", "words", starts.alias("first")).select(
        "family", F.slice("words", F.col("first"), F.col("length")).alias("words")
    )


def _pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


#: A template without a name in it is confirmed by this share of its word pairs, one with a name by the lower share.
WHOLE, PART = 0.75, 0.6


def _each(own: Column, n: Column, words: Column, code=str) -> Column:
    """Per template (share, fits, k, family), by number ``k`` from 1, of ``n`` word pairs, of which ``own`` are compared, and words.

    The share is that of the word pairs of the shorter of the two, at least two pairs, that the other
    holds too. A template with words that name its family fits from 0.6 on if these words are all
    there. One without fits if 0.75 of its own pairs, and its marks, are there, as licences borrow
    each other's sentences. The templates stand in the expression as literals, in the given code.
    """
    each = []
    for k, (family, notice) in enumerate(TEMPLATES):
        spoken = re.findall(r"[^\W_]+", notice.lower())
        pairs, names = _pairs(spoken), sorted(set(_NAMES[family].split()) & set(spoken))
        marks = sorted(set(_MARKS.get(family, "").split()) & set(spoken))
        both = F.size(F.array_intersect(own, F.array(*(F.lit(code(x)) for x in pairs))))
        share = both / F.greatest(F.lit(2), F.least(n, F.lit(len(pairs))))
        fits = share >= PART if names else both >= WHOLE * len(pairs)
        if names or marks:
            # Words are compared only where enough pairs agree.
            fits = fits & (F.size(F.array_except(F.array(*(F.lit(code(x)) for x in names + marks)), words)) == 0)
        each.append(F.struct(share.alias("share"), fits.alias("fits"), F.lit(k + 1).alias("k"), F.lit(family).alias("family")))
    return F.array(*each)


def _shares(df: DataFrame) -> DataFrame:
    """``df`` (words) with ``own``, its word pairs, and ``each`` template as ``_each`` has it."""
    paired = NGram(n=2, inputCol="words", outputCol="own").transform(df).withColumn("own", F.array_distinct("own"))
    return paired.withColumn("each", _each(F.col("own"), F.size("own"), F.col("words")))


def _matched(df: DataFrame, families: list[str]) -> DataFrame:
    """``df`` (words, chances by class number) with ``similarity``, the greatest to any template, and ``found``, all families confirmed.

    Templates that fit are taken up by similarity and their family's probability: the first as it is,
    each further one if 0.6 of its pairs that no template before it holds are there. So several
    notices in one window are all found, and words that notices share confirm one of them only.
    """
    ranked = _shares(df)
    own = F.col("own")
    pairs = [_pairs(re.findall(r"[^\W_]+", notice.lower())) for _, notice in TEMPLATES]
    listed = F.array(*(F.array(*map(F.lit, x)) for x in pairs))
    numbers = F.array(*(F.lit(families.index(family) + 1) for family, _ in TEMPLATES))
    ranked = ranked.withColumn("similarity", F.array_max(F.transform("each", lambda x: x["share"])))
    ordered = F.transform(
        F.filter("each", lambda x: x["fits"]),
        lambda x: F.struct((x["share"] + F.element_at("chances", F.element_at(numbers, x["k"]))).alias("rank"), x["k"].alias("k"), x["family"].alias("family")),
    )
    ranked = ranked.withColumn("each", F.sort_array(ordered, asc=False))
    none = F.array().cast("array<string>")

    def take(taken: Column, x: Column) -> Column:
        mine = F.element_at(listed, x["k"])
        rest = F.array_except(mine, taken["pairs"])
        new = F.size(F.array_intersect(own, rest)) >= PART * F.size(rest)
        fits = (F.size(taken["found"]) == 0) | ((F.size(rest) > 0) & new)
        more = F.struct(F.array_union(taken["found"], F.array(x["family"])).alias("found"), F.array_union(taken["pairs"], mine).alias("pairs"))
        return F.when(fits, more).otherwise(taken)

    start = F.struct(none.alias("found"), none.alias("pairs"))
    return ranked.withColumn("found", F.aggregate("each", start, take, lambda taken: taken["found"])).drop("own", "each")


@dataclass
class Classifier:
    """A fitted model, its vocabulary and the single words in it, families by class number, and the least probability."""

    model: LogisticRegressionModel
    vectorizer: CountVectorizerModel
    words: list[str]
    families: list[str]
    threshold: float


def _spoken(templates: DataFrame) -> list[str]:
    """All words of the notices, then all their word pairs."""
    grams = _grams(templates).select(F.explode("grams").alias("gram")).distinct().collect()
    return sorted((r["gram"] for r in grams), key=lambda gram: (" " in gram, gram))


def _plain(paragraphs: DataFrame, spoken: list[str]) -> DataFrame:
    """(half, held, n): how many windows that are no notices hold the same of the ``spoken`` grams, by their numbers from 0.

    Notices are those that a template fits, and may be those with 0.4 of its pairs. ``half`` is 0 or 1, by the document.
    """
    code = {gram: k for k, gram in enumerate(spoken)}
    first = sum(" " not in gram for gram in spoken)
    paired = NGram(n=2, inputCol="words", outputCol="pairs").transform(paragraphs)
    paired = paired.withColumn("grams", F.concat("words", "pairs")).withColumn("size", F.size(F.array_distinct("pairs")))
    counted = CountVectorizerModel.from_vocabulary(spoken, inputCol="grams", outputCol="found").setBinary(True).transform(paired)
    held = counted.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.unwrap_udt("found")["indices"].alias("held"), "size"
    )
    # Without a pair of the notices the number of pairs does not matter.
    own = F.filter("held", lambda k: k >= first)
    size = F.when(F.size(own) > 0, F.col("size")).otherwise(0)
    held = held.select("half", "held", size.alias("size")).groupBy("half", "held", "size").agg(F.count(F.lit(1)).alias("n"))
    held = staged(held, "held").withColumn("own", own)
    each = _each(F.col("own"), F.col("size"), F.col("held"), code.__getitem__)
    plain = (F.size("own") == 0) | ~F.exists(each, lambda x: x["fits"] | (x["share"] >= 0.4))
    return held.where(plain).groupBy("half", "held").agg(F.sum("n").alias("n"))


def _vocabulary(spoken: list[str], plain: DataFrame, most: float) -> tuple[list[str], list[str]]:
    """Words and word pairs of the notices that tell them from plain paragraphs, and the single words among them.

    A word counts if fewer than ``most`` of the plain paragraphs hold it, a pair if one of its words
    counts. Both lists are bounded by the templates.
    """
    count = plain.agg(F.sum("n")).first()[0] or 0
    heard = {r["k"]: r["n"] for r in plain.select(F.explode("held").alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    words = [gram for k, gram in enumerate(spoken) if " " not in gram and heard.get(k, 0) <= most * count]
    kept = set(words)
    pairs = [gram for gram in spoken if " " in gram and kept & set(gram.split(" "))]
    return words + pairs, words


def _of_vocabulary(plain: DataFrame, spoken: list[str], vocabulary: list[str]) -> DataFrame:
    """(grams, n): how many windows hold the same grams of the vocabulary."""
    kept = set(vocabulary)
    listed = F.array(*(F.lit(gram if gram in kept else None) for gram in spoken)).cast("array<string>")
    grams = F.filter(F.transform("held", lambda k: F.element_at(listed, k + 1)), lambda gram: gram.isNotNull())
    return plain.select(grams.alias("grams"), "n").groupBy("grams").agg(F.sum("n").alias("n"))


#: Steps of the probability in which its distribution over unknown windows is held.
STEPS = 10_000


def _level(scored: DataFrame, part: float) -> float | None:
    """The least probability, to a step, that ``part`` of the windows (noticed, n) do not exceed; None without any."""
    steps = scored.groupBy(F.floor(F.col("noticed") * STEPS).alias("step")).agg(F.sum("n").alias("n"), F.max("noticed").alias("noticed"))
    rows = sorted(steps.collect(), key=lambda r: r["step"])
    whole, so_far = sum(r["n"] for r in rows), 0
    for r in rows:
        so_far += r["n"]
        if so_far >= part * whole:
            return r["noticed"]
    return None


def _drawn(docs: DataFrame, doc_id: str, text: str, sample: int, longest: int) -> DataFrame:
    """(doc_id, t) of at most ``sample`` ids of the least hashes, one text each (the least) of up to ``longest`` characters.

    A bound on the hash, set from the number of rows, leaves about half as many again before the
    least are taken, so that no task reads more than that few texts however many partitions there are.
    """
    share = min(1.0, 1.5 * sample / max(1, docs.count()))
    bound = min(2**63 - 1, int(share * 2**64) - 2**63)
    few = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    few = few.where((F.xxhash64("doc_id") <= bound) & (F.length("t") <= longest))
    few = few.groupBy("doc_id").agg(F.min("t").alias("t"))
    return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int | None = None, longest: int = 20_000, most: float = 0.005) -> Classifier:
    """Train on runs of the templates, and as unknown on decoys and on the paragraphs of all documents.

    Features are the words and word pairs of the templates but for words that a share of ``most`` of
    the paragraphs hold. A window without any of these words has no features and is unknown, so that
    scans can pass over it without changing a result.

    All windows of all rows count, each once; they are grouped by what they hold of the templates'
    words and pairs, and a group weighs as much as it has windows. Those with words of licences too
    are unknown unless a template fits them or 0.4 of its pairs are there, as they may be notices.
    The half of the documents that trains weighs no more than the notices do, whatever its number;
    on the other half the probability of a notice of any family is found that 99.9 of 100 unknown
    windows do not exceed, and windows below it count as unknown. Without any such window the level
    is 0.5. A caller can have a ``sample`` of at most so many documents of up to ``longest``
    characters, by a hash of their ids, in place of all.
    """
    spark = docs.sparkSession
    templates = _templates(spark)
    read = _paragraphs(docs, doc_id, text) if sample is None else _paragraphs(_drawn(docs, doc_id, text, sample, longest), "doc_id", "t")
    spoken = _spoken(templates)
    plain = staged(_plain(read, spoken), "plain")
    decoys = spark.range(1).select(F.explode(F.array(*map(F.lit, _DECOYS))).alias("t")).select(F.lit(UNKNOWN).alias("family"), words_of(F.col("t")).alias("words"))
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    vocabulary, words = _vocabulary(spoken, plain.where("half = 0"), most)
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    examples = _grams(_windows_of_templates(templates).unionByName(decoys)).select("family", "grams", F.when(F.col("family") == UNKNOWN, 1.0).otherwise(2.0).alias("weight"))
    weights = examples.where(F.col("family") != UNKNOWN).agg(F.sum("weight")).first()[0]
    seen = _of_vocabulary(plain.where("half = 0"), spoken, vocabulary)
    share = min(1.0, weights / max(1, seen.agg(F.sum("n")).first()[0] or 0))
    seen = seen.select(F.lit(UNKNOWN).alias("family"), "grams", (F.col("n") * share).alias("weight"))
    blank = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("grams"), F.lit(50.0).alias("weight"))
    rows = examples.unionByName(blank).coalesce(1).unionByName(seen).withColumn("label", number.cast("double"))
    weighed = vectorizer.transform(rows).select("label", "features", "weight")
    model = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", weightCol="weight").fit(weighed)
    others = vectorizer.transform(_of_vocabulary(plain.where("half = 1"), spoken, vocabulary))
    noticed = 1 - F.element_at(vector_to_array("probability"), 1)
    level = _level(model.transform(others).select(noticed.alias("noticed"), "n"), 0.999)
    return Classifier(model, vectorizer, words, families, 0.5 if level is None else level)


def notices(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window that the classifier calls a notice, and family: doc_id, paragraph, window, family, probability, similarity, confirmed.

    A window with several confirmed families has a row for each; one with none has a row with the
    likeliest. probability is that of a notice of any family, so that two notices in one window do
    not take it from each other; similarity is the greatest to a template.
    """
    paragraphs = _grams(_paragraphs(docs, doc_id, text, classifier.words))
    scored = classifier.model.transform(classifier.vectorizer.transform(paragraphs))
    chances = scored.select("doc_id", "paragraph", "window", "words", vector_to_array("probability").alias("chances"))
    chances = chances.withColumn("probability", 1 - F.element_at("chances", 1)).where(F.col("probability") >= classifier.threshold)
    known = F.slice("chances", 2, len(classifier.families))
    likeliest = F.element_at(F.array(*map(F.lit, classifier.families[1:])), F.array_position(known, F.array_max(known)).cast("int"))
    found = _matched(chances.withColumn("likeliest", likeliest), classifier.families)
    named = F.when(F.size("found") > 0, F.col("found")).otherwise(F.array("likeliest"))
    return found.select("doc_id", "paragraph", "window", F.explode(named).alias("family"), "probability", "similarity", (F.size("found") > 0).alias("confirmed"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """One row per document: doc_id, families, n_confirmed, n_unconfirmed, probability.

    families are all those confirmed, also several of one paragraph or window, sorted and joined by commas;
    the counts are of paragraphs, and probability is the highest of a confirmed one (0 without). A
    paragraph is the text between blank lines, so a notice may be wrapped at any width; every
    paragraph of every text is classified, long ones in overlapping windows of 64 words. A window
    that is called a notice counts as confirmed if a template fits it: by its words that name the
    family and 0.6 of the word pairs of the shorter of the two, or where it names none by 0.75 of its own; a
    further family of the same window needs word pairs of its own. A null or empty text has no
    notices; rows that repeat an id are one document (paragraphs of one number count once), those
    with a null id too. Other columns are not read. An empty table gives no rows.
    """
    model = classifier or fit(docs, doc_id, text)
    found = notices(docs, model, doc_id, text)
    sure = F.col("confirmed")
    hits = found.groupBy("doc_id", "paragraph").agg(
        F.max("confirmed").alias("sure"), F.max(F.when(sure, F.col("probability"))).alias("best"), F.collect_set(F.when(sure, F.col("family"))).alias("named")
    ).drop("paragraph")
    every = docs.select(F.col(doc_id).alias("doc_id"), *(F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("sure", "best", "named")))
    # Each document stands beside its notices, so that no join is needed; sums are partial first.
    # A set holds at most all families.
    sets = F.array_distinct(F.flatten(F.collect_set("named")))
    return every.unionByName(hits).groupBy("doc_id").agg(
        F.array_join(F.array_sort(sets), ",").alias("families"),
        F.count(F.when(F.col("sure"), 1)).alias("n_confirmed"),
        F.count(F.when(~F.col("sure"), 1)).alias("n_unconfirmed"),
        F.coalesce(F.max("best"), F.lit(0.0)).alias("probability"),
    )
