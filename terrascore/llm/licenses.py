"""Licence scan: an exact set-similarity join of text blocks with licence
templates.

A block is a line of a text, or a window of ``WINDOW`` words of a paragraph
(lines up to a blank one), so that a notice wrapped over lines is found; the
windows overlap by half, which is at least the longest template.  A block
matches a template when it holds at least ``threshold`` of the template's
distinct words.  Words are ordered by
their frequency over all blocks of the corpus, rarest first.  A block that
reaches the overlap wanted must share one of the template's rarest
|T| - wanted + 1 words (prefix filter), have enough of the templates' words
at all (length filter) and, from the places of the shared word in both
orders, enough words left (positional filter).  What passes is counted
exactly, so the filters only save work.

The templates are a short list given as a parameter; only their words, not
the corpus, reach the driver and the join's broadcast side.  Only built-in
functions run; texts are read once, and what is written holds the template
words of each block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.llm.shared import documents
from terrascore.session import materialize

THRESHOLD = 0.9
#: words of a window, at least: twice the longest template if that is more
WINDOW = 40

# fixed values: phrases and labels that the scan always reports
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, wording): notices as their publishers word them
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("agpl", "This program is licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(wording: str) -> list[str]:
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", wording.translate(str.maketrans(UPPER, LOWER)))))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" ")))).cast("long")


def window_words(templates=None) -> int:
    templates = TEMPLATES if templates is None else templates
    return max([WINDOW, *(2 * len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for _, t in templates)])


def scan_blocks(docs: DataFrame, vocabulary: list[str], phrases: dict[str, str] | None = None,
                window: int | None = None) -> DataFrame:
    """One pass over the texts: doc_id, text_hash, n_words, the phrases'
    places, and the template words of each block: the lines, then, with
    ``window``, overlapping windows of so many words over the paragraphs that
    have several lines or more words.  A line of more words is no block of its
    own, so that words scattered over it are no match."""
    phrases = PHRASES if phrases is None else phrases
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    lines = F.transform(F.split(low, "\n"), lambda x: F.trim(F.regexp_replace(x, SEPARATORS, " ")))
    x = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    x = x.withColumn("joined", F.array_join(F.filter("lines", lambda s: s != ""), " "))
    x = x.withColumn("n_words", F.when(F.col("joined") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("joined")) + 1))
    x = x.withColumn("joined", F.concat(F.lit(" "), "joined", F.lit(" ")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        here = F.contains("joined", F.lit(f" {phrase} "))
        counts.append(F.when(here, F.regexp_count("joined", F.lit(f"(?<= ){phrase}(?= )")).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(here, _spaces(F.substring_index("joined", f" {phrase} ", 1))))
        lasts.append(F.when(here, F.col("n_words") - len(phrase.split()) - _spaces(F.substring_index("joined", f" {phrase} ", -1))))
        labels.append(F.when(here, F.lit(label)))
    known = F.array(*[F.lit(w) for w in vocabulary])
    cut_lines = F.transform("lines", lambda s: F.split(s, " "))
    if window:
        empty = F.array().cast("array<string>")
        words = F.transform(cut_lines, lambda w: F.when(F.size(w) <= window, F.array_intersect(w, known)).otherwise(empty))
        step = window // 2
        paragraphs = F.filter(F.transform(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda p: F.trim(p, F.lit("\n"))),
                              lambda p: F.contains(p, F.lit("\n")) | (_spaces(p) >= window))
        # the last window starts where it still has words that the one before lacks
        cut = lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - window) / step).cast("int"), F.lit(0))),
            lambda k: F.array_intersect(F.slice(w, k * step + 1, window), known))
        split = F.transform(paragraphs, lambda p: F.split(F.translate(p, "\n", " "), " "))  # once, not for every window
        words = F.concat(words, F.flatten(F.transform(split, cut)))
    else:
        words = F.transform(cut_lines, lambda w: F.array_intersect(w, known))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    many = len(phrases) > 1
    return x.select("doc_id", "text_hash", "n_words", total.alias("n_base"),
                    (F.least(*firsts) if many else firsts[0]).alias("first_word"),
                    (F.greatest(*lasts) if many else lasts[0]).alias("last_word"),
                    F.array_compact(F.array(*labels)).alias("base"), words.alias("blocks"))


def matches(scanned: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """Scanned texts -> doc_id, text_hash, block (line from 0, then
    windows), template (place in the list), label, containment: every block that reaches the
    threshold, once."""
    templates = TEMPLATES if templates is None else templates
    sets = [template_words(t) for _, t in templates]
    wanted = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    blocks = (scanned.select("doc_id", "text_hash", F.posexplode("blocks").alias("block", "words"))
              .where(F.size("words") >= min(wanted)))
    freq = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # words of the templates only
    order = sorted({w for s in sets for w in s}, key=lambda w: (freq.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for k, (s, (label, _)) in enumerate(zip(sets, templates)):
        ranked = sorted(s, key=place.get)
        for i, w in enumerate(ranked[:len(s) - wanted[k] + 1]):
            rows.append((w, k, label, i, len(s), wanted[k], ranked))
    spark = scanned.sparkSession
    prefixes = spark.createDataFrame(rows, "word string, template int, label string, i int, n int, wanted int, ranked array<string>")
    starts = sorted({r[0] for r in rows})
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words"))
    near = (blocks.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in starts])))
            .withColumn("words", ordered)
            .select("doc_id", "text_hash", "block", "words", F.posexplode("words").alias("j", "word"))
            .where(F.col("j") <= F.size("words") - min(wanted))
            .join(F.broadcast(prefixes), "word")
            .where((F.size("words") >= F.col("wanted"))
                   & (F.least(F.col("n") - F.col("i"), F.size("words") - F.col("j")) >= F.col("wanted"))))
    both = F.size(F.array_intersect("words", "ranked"))
    return (near.where(both >= F.col("wanted"))
            .groupBy("doc_id", "text_hash", "block", "template", "label")
            .agg(F.max(both / F.col("n")).alias("containment")))


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> a row per row: n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    The phrases are found wherever their words stand one after the other;
    the join adds the labels of templates a line or window contains.  ``score`` is 1
    with a phrase, else the best containment, else 0.  NULL and empty text
    has no words and no labels; rows with the same doc_id and text get the
    same result; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    scanned = materialize(scan_blocks(docs, vocabulary, window=window_words(templates)), "licence-blocks")
    found = (matches(scanned, templates, threshold).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))  # a set of the list's labels
    base = scanned.drop("blocks")
    joined = base.join(found, base["doc_id"].eqNullSafe(found["_d"]) & (base["text_hash"] == found["_h"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    sep = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"({i}, '{label}', {template_words(t)}, {max(1, math.ceil(THRESHOLD * len(template_words(t)) - 1e-9))})"
                     for i, (label, t) in enumerate(TEMPLATES))
    places = " + ".join(
        "[{{'at': i, 'label': '{1}'}} FOR i IN range(len(w)) IF {0}]".format(
            " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())), label)
        for p, label in PHRASES.items())
    W = window_words()
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
t(k, label, words, wanted) AS (VALUES {rows}),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{sep}') AS w FROM d),
p AS (SELECT r, doc_id, w, {places} AS hits FROM w),
l AS (SELECT r, unnest([regexp_extract_all(x, '{sep}') FOR x IN string_split(low, chr(10))]) AS ws,
             unnest(range(len(string_split(low, chr(10))))) AS i FROM d),
-- a paragraph is a run of lines with words
o AS (SELECT r, i, ws, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM l WHERE len(ws) > 0),
q AS (SELECT r, run, count(*) AS lines, flatten(list(ws ORDER BY i)) AS ws FROM o GROUP BY r, run),
v AS (SELECT r, ws, unnest(range(greatest(ceil((len(ws) - {W}) / {W // 2}::DOUBLE)::BIGINT, 0) + 1)) AS k FROM q WHERE lines > 1 OR len(ws) > {W}),
b AS (SELECT r, list_distinct(ws) AS s FROM l WHERE len(ws) <= {W}
      UNION ALL SELECT r, list_distinct(ws[k * {W // 2} + 1 : k * {W // 2} + {W}]) FROM v),
m AS (SELECT r, label, max(len(list_intersect(s, words))::DOUBLE / len(words)) AS c
      FROM b, t WHERE len(list_intersect(s, words)) >= wanted GROUP BY r, label),
g AS (SELECT r, list(label) AS more, max(c) AS best FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(hits)::BIGINT AS n_base,
       list_min([h.at FOR h IN hits])::BIGINT AS first_word, list_max([h.at FOR h IN hits])::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct([h.label FOR h IN hits])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct([h.label FOR h IN hits] + coalesce(more, []))), ',') AS labels,
       CASE WHEN len(hits) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN g USING (r)
"""


OP1_SQL = _sql()
