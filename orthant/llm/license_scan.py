"""Licence scan: exact set-similarity join of text blocks with licence templates.

Base: a document's words (lower case; runs of 0-9, a-z and anything beyond ASCII) and the places where
the words of a fixed phrase stand one after another.

Method: blocks are lines of a text; block and template are sets of words. Every (block, template) with
|block & template| >= threshold * |template| is found: template words are put in a global order, rarest in the
corpus first; a template's prefix has |T| - need + 1 words, of which a matching block must hold one; the length
filter drops blocks with fewer template words than any template needs; the positional filter drops pairs where
the words left after the first shared one can't reach `need`; what is left is verified. Lines are exploded only
where they hold enough words of the templates, and words only of those. The tables of templates, ranks and
prefixes are bounded by the template constants, whatever the corpus, so the join broadcasts them.
Notices that are wrapped over lines are found in windows of consecutive words, len(template) / threshold of them, from
every template word on: a text needs `need` of the template's words at all, a window its `need`-th one near enough;
what is left is verified. Of lines and windows alike a template wants the words that name its licence.

DataFrame code only; no Python runs on the executors. One pass lowers A-Z and splits the texts; a checkpoint keeps their
numbers, the lines that hold enough template words, and the words of texts in which a template's words stand at all.
Shuffles carry counts of template words, matched blocks and a few numbers for each document.

Edge cases: a null text is empty: no words, no labels, score 0; repeated rows each get their results; documents
that share an id but not the text are kept apart; extra columns are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import checkpoint, lower_ascii, table

#: Phrase -> label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, template): opening sentences of public licences and the usual notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Words that a block must hold to name the licence, where the template has them.
NAMES = {"mit": ("mit",), "apache-2": ("apache",), "gpl-3": ("gnu", "3"), "gpl-2": ("gnu", "2"), "cc-by-nc": ("nc",), "cc-by": ("attribution",), "mpl-2": ("mozilla",)}
THRESHOLD = 0.8
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column):
    """The words of a lower-cased column. Splitting leaves an empty string at an end that is no word."""
    return F.array_remove(F.split(column, _SEPARATORS), "")


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(re.findall(r"[0-9a-z]+", text.lower())))) for label, text in templates]


def needs(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _match_lines(made: DataFrame, templates, threshold: float) -> DataFrame:
    """_key, _hash, label, containment: every line and template at the threshold."""
    spark = made.sparkSession
    sets = template_sets(templates)
    vocabulary = sorted({w for _, s in sets for w in s})
    blocks = made.select("_key", "_hash", F.explode("_lines").alias("_line")).select("_key", "_hash", "_line.block", "_line.held")
    frequency = {r.w: r.n for r in blocks.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a template word at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefixes, whole = [], []
    for number, (label, words) in enumerate(sets):
        ordered, need = sorted(rank[w] for w in words), needs(len(words), threshold)
        whole.append((number, label, need, len(words), ordered, [rank[w] for w in NAMES.get(label, ()) if w in words]))
        prefixes += [(r, number, place) for place, r in enumerate(ordered[: len(ordered) - need + 1])]
    index = F.broadcast(spark.createDataFrame(prefixes, "_rank int, _template int, _place int"))
    full = F.broadcast(spark.createDataFrame(whole, "_template int, label string, _need int, _size int, _ranks array<int>, _names array<int>"))
    ranks = F.create_map(*(x for w, r in rank.items() for x in (F.lit(w), F.lit(r))))
    candidates = (
        blocks.select("_key", "_hash", "block", F.sort_array(F.transform("held", lambda w: ranks[w])).alias("_own"))
        .select("_key", "_hash", "block", "_own", F.posexplode("_own").alias("_at", "_rank"))
        .join(index, "_rank")
        .join(full, "_template")
        .where(F.least(F.col("_size") - F.col("_place"), F.size("_own") - F.col("_at")) >= F.col("_need"))
    )
    shared = F.size(F.array_intersect("_own", "_ranks"))
    named = F.size(F.array_except("_names", "_own")) == 0
    return candidates.where((shared >= F.col("_need")) & named).select("_key", "_hash", "label", (shared / F.col("_size")).alias("containment")).distinct()


def _likely_templates(held, templates, threshold: float):
    """The templates of which a text with these words can hold a window."""
    likely = []
    array = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    for (label, words), (_, template) in zip(template_sets(templates), templates):
        names, need = [w for w in NAMES.get(label, ()) if w in words], needs(len(words), threshold)
        length = math.ceil(len([w for w in re.split(r"[^0-9a-z]+", template.lower()) if w]) / threshold)
        one = F.struct(F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(length).alias("length"), array(words).alias("words"), array(names).alias("names"))
        likely.append(F.when((F.size(F.array_intersect(held, one["words"])) >= need) & (F.size(F.array_except(one["names"], held)) == 0), one))
    return F.array_compact(F.array(*likely))


def _match_windows(made: DataFrame) -> DataFrame:
    """_key, _hash, label, containment: the best window of consecutive words of every text and template at the threshold."""
    found = made.where(F.size("_likely") > 0).select("_key", "_hash", "_words", F.explode("_likely").alias("_t"))
    t = F.col("_t")
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda h: F.array_contains(t["words"], h["w"]))
    # one expression a step, so that none is computed for every start again
    found = found.select("_key", "_hash", "_t", hits.alias("_hits"))
    starts = F.filter(F.transform("_hits", lambda h, j: F.struct(h["at"].alias("at"), j.alias("j"))), lambda s: F.get("_hits", s["j"] + t["need"] - 1)["at"] < s["at"] + t["length"])
    found = found.select("_key", "_hash", "_t", "_hits", F.explode(starts).alias("_s"))
    near = F.filter(F.slice("_hits", F.col("_s.j") + 1, t["length"]), lambda h: h["at"] < F.col("_s.at") + t["length"])
    found = found.select("_key", "_hash", "_t", F.array_distinct(F.transform(near, lambda h: h["w"])).alias("_own"))
    found = found.where((F.size("_own") >= t["need"]) & (F.size(F.array_except(t["names"], F.col("_own"))) == 0))
    return found.groupBy("_key", "_hash", t["label"].alias("label")).agg(F.max(F.size("_own") / F.size(t["words"])).alias("containment"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels and labels (arrays, sorted) and score of each document."""
    sets = template_sets(templates)
    vocabulary = sorted({w for _, s in sets for w in s})
    least = min(needs(len(s), threshold) for _, s in sets)
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_hash"), F.transform(F.split(lower_ascii(body), "\n"), _words).alias("_by_line"))
    known = F.array(*map(F.lit, vocabulary))
    lines = F.filter(F.transform("_by_line", lambda w, i: F.struct(i.alias("block"), F.array_intersect(w, known).alias("held"))), lambda x: F.size(x["held"]) >= least)
    step = step.select("_key", "_hash", F.flatten("_by_line").alias("_words"), lines.alias("_lines"))
    step = step.withColumn("_held", F.array_intersect("_words", known))
    rare = [[w for w in p.split() if len(w) > 3] or p.split() for p in phrases]
    likely = F.lit(False)
    for words in rare:
        every = F.lit(True)
        for w in words:
            every = every & F.array_contains("_words", w)
        likely = likely | every
    step = step.withColumn("_joined", F.when(likely, F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")))).withColumn("_likely", _likely_templates(F.col("_held"), templates, threshold))
    found = step.select("_key", "_hash", "_lines", "_likely", F.when(F.size("_likely") > 0, F.col("_words")).alias("_words"), F.size("_words").cast("long").alias("n_words"), *(F.split("_joined", " " + p.replace(" ", "  ") + " ").alias(f"_p{i}") for i, p in enumerate(phrases)))
    size = lambda part: F.when(F.btrim(part) == "", F.lit(0)).otherwise(F.size(F.split(F.btrim(part), "  ")))
    places, firsts, lasts, labels = F.lit(0), [], [], []
    for i, (phrase, label) in enumerate(phrases.items()):
        parts = F.col(f"_p{i}")
        here = F.coalesce(F.size(parts) > 1, F.lit(False))
        places = places + F.when(here, F.size(parts) - 1).otherwise(0)
        firsts.append(F.when(here, size(F.get(parts, F.lit(0)))))
        lasts.append(F.when(here, F.col("n_words") - size(F.element_at(parts, -1)) - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    made = checkpoint(found.select(
        "_key", "_hash", "_lines", "_likely", "_words", "n_words", places.cast("long").alias("n_base"),
        F.array_min(F.array(*firsts)).cast("long").alias("first_word"), F.array_max(F.array(*lasts)).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"),
    ))
    matched = checkpoint(_match_lines(made, templates, threshold).unionByName(_match_windows(made)))
    best = matched.groupBy("_key", "_hash").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    none = F.array().cast("array<string>")
    joined = made.join(best, made["_key"].eqNullSafe(best["_key"]) & (made["_hash"] == best["_hash"]), "left")
    return joined.select(
        made["_key"].alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("_more", none))).alias("labels"),
        F.greatest(F.coalesce("_best", F.lit(0.0)), (F.col("n_base") > 0).cast("double")).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def _oracle() -> str:
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    rows = ", ".join(f"('{label}', {needs(len(s), THRESHOLD)}, {s!r})" for label, s in template_sets())
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in PHRASES.items())
    return f"""
WITH t(label, need, words) AS (VALUES {rows}),
ph(label, ws) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {pattern}) AS w FROM documents),
pl AS (SELECT doc_id, label, p FROM (SELECT doc_id, label, w, ws, unnest(range(1, len(w) - len(ws) + 2)) AS p FROM d, ph WHERE len(w) >= len(ws) AND list_has_all(w, ws)) WHERE w[p : p + len(ws) - 1] = ws),
b AS (SELECT doc_id, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list(DISTINCT label) AS ls FROM pl GROUP BY doc_id),
l AS (SELECT doc_id, regexp_extract_all(x, {pattern}) AS w FROM (SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS x FROM documents)),
m AS (SELECT doc_id, label, len(list_intersect(list_distinct(l.w), words)) / len(words) AS c FROM l, t WHERE len(list_intersect(list_distinct(l.w), words)) >= need),
g AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(g.ls, [])))), ','), '') AS labels,
  greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)
"""


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {"op6_license_scan": _oracle()}
