"""License scan as an exact set-similarity join of text blocks with templates, in DataFrame functions only.

A text is its words (`WORD`, A-Z in lower case). A template is a set of words with a threshold; its block is a stretch of
words twice as wide as the template's class, with a start every half width, so that whatever is as long as a template lies whole in a
block. A block meets a template if it holds at least need = ceil(threshold * words) of the template's distinct words.

Words are ordered by the number of documents that hold them, rarest first, the same order everywhere. In that order
* prefix filter: a block that holds need words of a template shares one of the template's first words - need + 1, among its own
  first words - need + 1; only these are joined with an index of the templates' prefixes;
* length filter: blocks with fewer words than need drop out before that;
* positional filter: from the first shared word on, what is left of the template and of the block has to suffice. A pair is
  looked at under its first shared word only, so each pair comes once without a shuffle.
What is left is confirmed on the full sets. Words that no template has cannot count, so they are not in a block's set; the block's
set in the global order is one intersection with the ordered words.

Phrases are templates too, of threshold 1; a block that holds all words of one is searched for the places where they stand in
order, of which those in the block's first half are its own.

Everything but a document's sums is narrow; sums are combined in the task that read the document. The templates' words and
index are literals of the plan, MOST_WORDS at most.

Defined results: null text: empty, no words; a null doc_id is kept; repeated rows come out as often as they are; an empty table gives
no rows; other columns, whatever their names, are not carried along. Blocks of one document that meet one template are rows of their
own in blocks().
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_WIDTH = 16
#: Words of all templates together, as they are literals of the plan.
MOST_WORDS = 50_000
#: Share of a template's distinct words that a block has to hold.
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """A text whose words a block should hold; phrase: they have to stand in order too."""

    label: str
    text: str
    threshold: float = THRESHOLD
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def need(self) -> int:
        return math.ceil(round(self.threshold * len(set(self.words)), 9))

    @property
    def width(self) -> int:
        """The class: a power of two that the words do not exceed."""
        return max(LEAST_WIDTH, 1 << (len(self.words) - 1).bit_length())


#: The phrases of the base labels.
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)

#: One-line notices, of which every word has to be there, and the public wording of license notices.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 1.0),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", 1.0),
    Template("mit", "under the MIT License", 1.0),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", 1.0),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", 1.0),
    Template("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", 1.0),
    Template("cc0-1.0", "released under CC0 1.0 public domain", 1.0),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", 1.0),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", 1.0),
)


def words_of(text: str) -> Column:
    """The words of a text, A-Z in lower case and other letters as they are."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def words_by_frequency(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> list[str]:
    """The templates' words, those in the fewest documents first: the global order. A row for each word comes back."""
    own = sorted({w for t in templates for w in t.words})
    if len(own) > MOST_WORDS:
        raise ValueError(f"the templates have {len(own)} words, more than {MOST_WORDS}")
    held = docs.select(F.explode(F.array_intersect(F.lit(own), words_of(text))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(own, key=lambda w: (counts.get(w, 0), w))


def prefix_index(docs: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """The index: for each template and each place of its prefix a row with the class's width, the word, the place, and the template."""
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for n, t in enumerate(templates):
        own = sorted(set(t.words), key=rank.__getitem__)
        for place in range(len(own) - t.need + 1):
            of = {"width": t.width, "word": own[place], "place": place, "template": n, "label": t.label, "need": t.need, "tokens": own, "phrase": t.words if t.phrase else None}
            entries.append(F.struct(*[(F.lit(None).cast("array<string>") if v is None else F.lit(v)).alias(k) for k, v in of.items()]))
    return docs.sparkSession.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def blocks(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each block of a document and template that it meets: doc_id, print_1 and print_2 (of the text), part (of the scan),
    n_words, start (of the block), template, label, held and size (the template's words in the block, and of all), places (of a
    phrase that start in the block's own half; null for notices). Besides, a row with a null template for each document."""
    order = words_by_frequency(docs, templates, text)
    rank = {w: i for i, w in enumerate(order)}
    classes = {w: [t for t in templates if t.width == w] for w in sorted({t.width for t in templates})}
    known = {w: sorted({x for t in own for x in t.words}, key=rank.__getitem__) for w, own in classes.items()}
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.spark_partition_id().alias("part"), F.col(key).alias("doc_id"), F.xxhash64(whole).alias("print_1"), F.xxhash64(F.lit("again"), whole).alias("print_2"), words_of(text).alias("words")
    ).withColumn("n_words", F.size("words").cast("long"))
    # a class for the document itself, then the blocks of each class of templates
    stretch = lambda w: F.transform(F.sequence(F.lit(0), F.size("words"), F.lit(w)), lambda s: F.struct(F.lit(w).alias("width"), s.alias("start")))
    own = F.array(F.struct(F.lit(0).alias("width"), F.lit(0).alias("start")))
    rows = rows.withColumn("block", F.explode(F.concat(own, *[stretch(w) for w in classes]))).select("*", "block.width", "block.start").drop("block")
    around = F.slice("words", F.col("start") + 1, 2 * F.col("width"))
    held, least = F.array().cast("array<string>"), F.lit(1)
    for w in classes:
        held = F.when(F.col("width") == w, F.array_intersect(F.lit(known[w]), around)).otherwise(held)
        least = F.when(F.col("width") == w, min(t.need for t in classes[w])).otherwise(least)
    rows = rows.withColumn("own", held).withColumn("_least", least).where("width = 0 OR size(own) >= _least")
    prefix = F.posexplode_outer(F.slice("own", F.lit(1), F.greatest(F.size("own") - F.col("_least") + 1, F.lit(0)))).alias("at", "word")
    rows = rows.select("*", prefix).drop("_least")
    index = F.broadcast(prefix_index(docs, templates, order))
    met = rows.join(index, ["width", "word"], "left").where("width = 0 OR template IS NOT NULL")
    rest = 1 + F.least(F.size("tokens") - F.col("place") - 1, F.size("own") - F.col("at") - 1)
    first = ~F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("place")), F.slice("own", F.lit(1), F.col("at")))
    met = met.where(F.col("template").isNull() | ((rest >= F.col("need")) & first)).withColumn("held", F.size(F.array_intersect("tokens", "own"))).where("template IS NULL OR held >= need")
    stands = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.slice("words", F.col("start") + k + 1, F.size("phrase")) == F.col("phrase"))
    places = F.when(F.col("phrase").isNotNull(), F.transform(stands, lambda k: (F.col("start") + k).cast("long")))
    met = met.withColumn("places", places).where("phrase IS NULL OR size(places) > 0")
    return met.select("part", "doc_id", "print_1", "print_2", "n_words", F.col("start").cast("long").alias("start"), "template", "label", "held", F.size("tokens").alias("size"), "places")


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, n_words, n_base (places of phrases), first_word and last_word (the smallest and largest of
    them, or null), base_labels (of phrases), labels (of notices too; both distinct, sorted, joined by commas), score (the largest
    share of a template's words in a block that meets it; 0 without one)."""
    found = blocks(docs, templates, text, key)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("places").isNotNull()
    # rows of one text and doc_id in a part of the scan are summed together, and come out as often as they are
    sums = found.groupBy("part", "doc_id", "print_1", "print_2").agg(
        F.count_if(F.col("template").isNull()).alias("times"), F.max("n_words").alias("n_words"), F.coalesce(F.sum(F.when(base, F.size("places"))), F.lit(0)).alias("n"),
        F.min(F.when(base, F.element_at("places", 1))).alias("first_word"), F.max(F.when(base, F.element_at("places", -1))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.coalesce(F.max(F.col("held") / F.col("size")), F.lit(0.0)).alias("score"),
    )
    out = sums.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", "n_words", F.expr("n div times").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score")


def sql(templates: tuple[Template, ...] = PHRASES + NOTICES) -> str:
    """The same in DuckDB: every block against every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n  ".join(f"('{t.label}', {t.width}, {t.need}, {quoted(sorted(set(t.words)))}, {quoted(t.words) if t.phrase else 'NULL'})" for t in templates)
    return rf"""
WITH template(label, width, need, tokens, phrase) AS (VALUES
  {rows}),
w AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
b AS (
  SELECT row, width, start, words, list_slice(words, start + 1, start + 2 * width) AS block
  FROM (SELECT row, words, width, unnest(range(0, len(words) + 1, width)) AS start FROM w, (SELECT DISTINCT width FROM template) x) y),
m AS (
  SELECT b.*, label, phrase, len(tokens) AS size, len(list_filter(tokens, lambda t: list_contains(block, t))) AS held
  FROM b JOIN template USING (width) WHERE len(list_filter(tokens, lambda t: list_contains(block, t))) >= need),
p AS (
  SELECT *, CASE WHEN phrase IS NOT NULL THEN
    list_filter(range(start, start + width), lambda k: list_slice(words, k + 1, k + len(phrase)) = phrase) END AS places FROM m),
s AS (
  SELECT row, CAST(sum(len(places)) AS BIGINT) AS n_base, min(places[1]) AS first_word, max(places[-1]) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (places IS NOT NULL))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(CAST(held AS DOUBLE) / size) AS score
  FROM p WHERE phrase IS NULL OR len(places) > 0 GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN s USING (row)
"""
