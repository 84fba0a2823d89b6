"""License scans by diagonal voting: where a text holds a template's words, whole or with some words changed.

Every run of K words of a text is joined, by its hash and then by its words, to the positions of the templates' runs. A hit at word
p of the text and word q of a template votes for the diagonal p - q, so that an unbroken copy of a template has all its
votes on one diagonal, and one with words put in or left out on a few neighbouring ones. Votes are summed by (document, template,
diagonal) on the map side; what is shuffled is sets of template positions, which are no more than the template has. Neighbouring diagonals
are merged, and a merged span is verified by the share of the template's words that its hits cover and by its length. Of verified spans that
overlap, those of the best coverage give their labels, since notices of one family differ in a few words only. Phrases ask for all
their words on one diagonal and give their labels whatever overlaps them.

The templates are broadcast if their positions are no more than ``cluster.BROADCAST_ROWS``, and joined by shuffle beyond. Texts are never
shuffled; results meet the documents' rows by id and a hash of the text.

Defined results: a null text has no words; rows that repeat an id and text have equal results; texts of any length are scanned whole, in one
row each; a null id is an id like any other; a template with fewer than K words is refused; without templates no text has labels; an
empty table gives an empty table; other columns are never read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copperleaf.cluster import broadcast_if_small, materialise
from copperleaf.llm.textcols import ascii_lower, row_key

#: What stands between words: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 3
#: A diagonal of a template counts from this share of its words on, and from two votes.
LEAST_VOTES = 0.1
#: Neighbouring diagonals are at most this share of the template's words apart; a span is at most so many times as long.
SHIFT, LONGEST = 0.25, 2.0

# The phrases of the base labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The notices that the licenses' own texts ask to be put into files, with the coverage that each must reach.
NOTICES = [
    ("agpl-3", 1.0, "GNU Affero General Public License version 3"),
    ("apache-2", 0.8, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4", 1.0, "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", 1.0, "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4", 1.0, "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", 0.8, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", 1.0, "GNU General Public License, version 2"),
    ("gpl-2", 0.8, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", 1.0, "GNU General Public License, version 3"),
    ("gpl-3", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mpl-2", 0.8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", 0.8, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def template_rows(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, float, str]] = NOTICES) -> list[tuple]:
    """(template, label, base, least, length, at, gram): a row for each run of K words of each template."""
    out = []
    every = [(label, True, 1.0, text) for label, text in phrases] + [(label, False, least, text) for label, least, text in notices]
    for i, (label, base, least, text) in enumerate(every):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template of fewer than {K} words: {text!r}")
        out += [(i, label, base, least, len(words), at, " ".join(words[at : at + K])) for at in range(len(words) - K + 1)]
    return out


TEMPLATE_SCHEMA = "template int, label string, base boolean, least double, length int, at int, gram string"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def template_hits(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, template, label, base, least, length, diagonal, ats): the template positions that vote for each diagonal."""
    slim = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), _words(ascii_lower(F.col(text_col))).alias("words"))
    run = F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(K)]))
    runs = slim.filter(F.size("words") >= K).select("id", "key", F.posexplode(run).alias("pos", "run")).withColumn("hash", F.xxhash64("run"))
    known = broadcast_if_small(materialise(templates.withColumn("gram_hash", F.xxhash64("gram")), "templates"))
    hits = runs.join(known, (F.col("hash") == F.col("gram_hash")) & (F.col("run") == F.col("gram")))
    return hits.groupBy("id", "key", "template", "label", "base", "least", "length", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))


def license_spans(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, template, label, base, first, last, coverage, verified): merged spans of words, last included.

    A row for each place of a phrase, and for each span of a notice with votes enough; a written table.
    """
    hits = template_hits(docs, templates, id_col, text_col)
    votes = F.size("ats")
    least = F.when(F.col("base"), F.col("length") - (K - 1)).otherwise(F.least(F.greatest(F.lit(2.0), F.col("length") * LEAST_VOTES), F.col("length") - (K - 1)))
    voted = hits.filter(votes >= least)
    group = W.partitionBy("id", "key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(group) > F.col("length") * SHIFT
    islands = voted.withColumn("new", F.when(F.col("base") | F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("new").over(group))
    merged = islands.groupBy("id", "key", "template", "label", "base", "least", "length", "island").agg(
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first"), F.max(F.col("diagonal") + F.array_max("ats") + K - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))))
    spans = merged.withColumn("coverage", covered / F.col("length"))
    fits = F.col("base") | (F.col("coverage") >= F.col("least")) & (F.col("last") - F.col("first") + 1 <= F.col("length") * LONGEST)
    return materialise(_best(spans.withColumn("fits", fits)).select("id", "key", "template", "label", "base", "first", "last", "coverage", "verified"), "license-spans")


def _best(spans: DataFrame) -> DataFrame:
    """With verified: of a document's fitting notices that overlap one another, those of the highest coverage; phrases always."""
    chain = W.partitionBy("id", "key", "rivals").orderBy("first", "last", "template")
    before = F.max("last").over(chain.rowsBetween(W.unboundedPreceding, -1))
    rivals = spans.withColumn("rivals", F.col("fits") & ~F.col("base"))
    heaps = rivals.withColumn("new", F.when(F.coalesce(F.col("first") > before, F.lit(True)), 1).otherwise(0)).withColumn("heap", F.sum("new").over(chain))
    top = F.max("coverage").over(W.partitionBy("id", "key", "rivals", "heap"))
    return heaps.withColumn("verified", F.col("fits") & (F.col("base") | (F.col("coverage") == top)))


def license_scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): a row for each document.

    score is the highest share of a template's words that stand in one span of the text, verified or not.
    """
    spans = license_spans(docs, templates, id_col, text_col)
    base = lambda c: F.when(F.col("base"), F.col(c))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(
        F.count_if("base").alias("n_base"), F.min(base("first")).alias("first_word"), F.max(base("first")).alias("last_word"),
        listed(base("label")).alias("base_labels"), listed(F.when(F.col("verified"), F.col("label"))).alias("labels"), F.max("coverage").alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.size(_words(F.col(text_col))).cast("long").alias("n_words"))
    both = rows.join(found, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    shown = lambda c: F.coalesce(F.col(c), none[c]).alias(c)
    return both.select("id", "n_words", shown("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"), shown("base_labels"), shown("labels"), shown("score"))


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(template_rows(), TEMPLATE_SCHEMA)


def op12_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_templates(spark)).withColumnRenamed("id", "doc_id")


def _literal(row: tuple) -> str:
    i, label, base, least, length, at, gram = row
    return f"({i}, '{label}', {base}, {least}, {length}, {at}, '{gram}')"


OP12_SQL = (
    "WITH t(template, label, base, least, length, spot, gram) AS (VALUES " + ", ".join(map(_literal, template_rows())) + r"""
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), h AS (
  SELECT r, template, label, base, least, length, pos - spot AS diagonal, list(DISTINCT spot) AS ats FROM g JOIN t USING (gram) GROUP BY ALL
), v AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > length * 0.25::DOUBLE, true) OR base AS fresh FROM h
  WHERE len(ats) >= CASE WHEN base THEN length - 2 ELSE least(greatest(2.0::DOUBLE, length * 0.1::DOUBLE), length - 2) END
), i AS (
  SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM v
), m AS (
  SELECT r, template, label, base, least, length, min(diagonal + list_min(ats)) AS first, max(diagonal + list_max(ats) + 2) AS last,
    len(list_distinct(flatten(list_transform(flatten(list(ats)), lambda a: [a, a + 1, a + 2])))) / CAST(length AS DOUBLE) AS coverage
  FROM i GROUP BY r, template, label, base, least, length, island
), f AS (
  SELECT *, (NOT base) AND coverage >= least AND last - first + 1 <= length * 2.0::DOUBLE AS fits FROM m
), c AS (
  SELECT *, coalesce(first > max(last) OVER (PARTITION BY r, fits ORDER BY first, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM f
), p AS (
  SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY r, fits ORDER BY first, last, template) AS heap FROM c
), s AS (
  SELECT *, base OR (fits AND coverage = max(coverage) OVER (PARTITION BY r, fits, heap)) AS verified FROM p
), a AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(coverage) AS score
  FROM s GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (r)
"""
)
