"""License scans by diagonal voting.

Every rolling gram of words is hashed and joined to the positions at which license templates hold it. A hit votes for a diagonal
(word of the text less word of the template): hits of one copy of a template agree on it, and inserted or dropped words move it by
a few. Votes are counted for each diagonal, neighbouring diagonals are merged, and what they propose is verified word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .word_arrays import mixed, slabs, words

#: Words of a gram (a shorter template is one gram), and percent of a template's words that a span must hold.
GRAM, SHARE = 4, 80
#: Diagonals at most so far apart are merged: one for each EVERY words of a template, MOST_SLACK at most. Below EVERY words all must be there.
EVERY, MOST_SLACK = 8, 8
#: Template positions up to which they are broadcast (about 30 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000

_ROW = np.random.default_rng(11).integers(1, 2**63, GRAM + 1, dtype=np.uint64) | np.uint64(1)
#: A-Z as a-z, other ASCII than letters and digits as spaces.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Template:
    """Words of a license text or of a notice, and the label that it gives. base: a phrase of which every place is reported."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return text_words(self.text)

    @property
    def gram(self) -> int:
        return min(GRAM, len(self.words))

    @property
    def slack(self) -> int:
        return min(len(self.words) // EVERY, MOST_SLACK)

    @property
    def least(self) -> int:
        m = len(self.words)
        return m if self.base or m < EVERY else -(-SHARE * m // 100)


# Phrases of licenses, the notices that they ask for and the openings of their texts.
TEMPLATES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def text_words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) runs of letters, digits and whatever is not ASCII."""
    return _WORD.findall((text or "").translate(_LOWER))


def rolling_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on."""
    out = np.full(max(len(hashes) - k + 1, 0), _ROW[GRAM] * np.uint64(k), np.uint64)
    for i in range(k):
        out += hashes[i : len(out) + i] * _ROW[i]
    return mixed(out)


def template_grams(templates: list[Template]) -> list[tuple[int, int, int]]:
    """gram, template and position of all grams of the templates."""
    out = []
    for t, x in enumerate(templates):
        data = _FOLD[np.frombuffer(x.text.encode(), np.uint8)]
        grams = rolling_grams(words(data, np.array([0, len(data)]))[0], x.gram).view(np.int64)
        out += [(int(g), t, at) for at, g in enumerate(grams)]
    return out


def scan(documents: DataFrame, templates: list[Template]) -> DataFrame:
    """row (a key of each row), doc_id, n_words and clusters: the hits of a text (word, gram), near ones together with the words around them.

    All grams of all words are hashed; those that no template has are dropped before they leave the task. Written once.
    """
    known = {k: np.unique(np.array([g for g, t, _ in template_grams(templates) if templates[t].gram == k], np.int64).view(np.uint64)) for k in sorted({t.gram for t in templates})}
    reach = max(len(t.words) for t in templates)
    kind = documents.schema["doc_id"].dataType.simpleString()
    cluster = pa.list_(pa.struct([("origin", pa.int64()), ("words", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("word", pa.int64()), ("gram", pa.int64())])))]))

    def found(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and grams of all hits of a slab, in order."""
        at, grams = [], []
        for k, of_k in known.items():
            g = rolling_grams(hashes, k)
            place = np.flatnonzero(of_k[np.minimum(np.searchsorted(of_k, g), len(of_k) - 1)] == g)
            place = place[place + k <= bounds[np.searchsorted(bounds, place, "right")]]
            at.append(place)
            grams.append(g[place].view(np.int64))
        place, gram = np.concatenate(at), np.concatenate(grams)
        order = np.argsort(place, kind="stable")
        return place[order], gram[order]

    def clusters(text: str, at: np.ndarray, grams: np.ndarray) -> list[dict]:
        listed, out = text_words(text), []
        cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
        for a, g in zip(np.split(at, cuts), np.split(grams, cuts)):
            origin = max(int(a[0]) - reach, 0)
            out.append({"origin": origin, "words": listed[origin : int(a[-1]) + reach], "hits": [{"word": x, "gram": y} for x, y in zip(a.tolist(), g.tolist())]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slabs(batch.column(1)):
                hashes, bounds = words(_FOLD[data], offsets)
                at, grams = found(hashes, bounds)
                first = np.searchsorted(at, bounds)
                rows = [clusters(batch.column(1)[a + r].as_py(), at[i:j] - bounds[r], grams[i:j]) if j > i else [] for r, (i, j) in enumerate(zip(first[:-1], first[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(rows, cluster)], names=["doc_id", "n_words", "clusters"])

    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, clusters array<struct<origin:long,words:array<string>,hits:array<struct<word:long,gram:long>>>>")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "license-scan")


def license_spans(scanned: DataFrame, templates: list[Template]) -> DataFrame:
    """row, template (its number), label, base, first and last (words), votes, held and size (words of the template, and those in place), verified.

    A word of the template is in place if the text has it on one of the merged diagonals.
    """
    spark = scanned.sparkSession
    positions = template_grams(templates)
    grams = spark.createDataFrame(positions, "gram long, template int, at int")
    about = spark.createDataFrame([(t, x.label, x.base, x.slack, x.least, x.words) for t, x in enumerate(templates)], "template int, label string, base boolean, slack int, least int, its_words array<string>")
    if len(positions) <= BROADCAST:
        grams, about = F.broadcast(grams), F.broadcast(about)
    each = scanned.select("row", F.explode("clusters").alias("c"))
    hits = each.select("row", "c.origin", F.explode("c.hits").alias("hit")).select("row", "origin", "hit.word", "hit.gram")
    diagonal = (F.col("word") - F.col("at")).alias("diagonal")
    votes = hits.join(grams, "gram").groupBy("row", "origin", "template", diagonal).agg(F.count("*").alias("votes")).join(about.select("template", "slack"), "template")
    w = Window.partitionBy("row", "origin", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.col("slack"), F.lit(True)).cast("int")
    merged = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy("row", "origin", "template", "run").agg(F.sum("votes").alias("votes"), F.collect_list("diagonal").alias("diagonals"))
    judged = merged.join(each.select("row", "c.origin", "c.words"), ["row", "origin"]).join(about, "template")
    word_at = lambda d, t: F.get("words", (d + t - F.col("origin")).cast("int"))
    in_place = F.filter(F.sequence(F.lit(0), F.size("its_words") - 1), lambda t: F.exists("diagonals", lambda d: F.coalesce(word_at(d, t) == F.get("its_words", t), F.lit(False))))
    held = judged.withColumn("in_place", in_place).withColumn("held", F.size("in_place"))
    return held.select(
        "row",
        "template",
        "label",
        "base",
        (F.array_min("diagonals") + F.array_min("in_place")).alias("first"),
        (F.array_max("diagonals") + F.array_max("in_place")).alias("last"),
        "votes",
        "held",
        F.size("its_words").alias("size"),
        (F.col("held") >= F.col("least")).alias("verified"),
    )


def scan_licenses(documents: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of documents.

    n_base counts the places of base templates, first_word and last_word are the first and last start (null without one);
    base_labels and labels are distinct, sorted and joined by commas (empty without one). score is the largest share of a template's
    words found in place, verified or not. A null text counts as empty; rows that repeat are scanned one by one, as are
    rows without doc_id; an empty table gives an empty result. Columns other than doc_id and text are ignored. The spans of a
    text are gathered by row, so that what one task holds is bounded by a text.
    """
    scanned = scan(documents, templates)
    spans = license_spans(scanned, templates)
    base, verified = F.col("base") & F.col("verified"), F.col("verified")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    told = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(verified).alias("labels"),
        F.max(F.col("held") / F.col("size")).alias("score"),
    )
    whole = scanned.select("row", "doc_id", "n_words").join(told, "row", "left").drop("row")
    return whole.fillna(0, ["n_base"]).fillna(0.0, ["score"]).fillna("", ["base_labels", "labels"])


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle(templates: list[Template]) -> str:
    rows = ",\n    ".join(f"({t}, '{x.label}', {x.base}, {x.gram}, {x.slack}, {x.least}, {x.words})" for t, x in enumerate(templates))
    return rf"""
WITH t(template, label, base, k, slack, least, its) AS (VALUES
    {rows}),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
g AS (SELECT d.id, pos, k, array_to_string(w[pos + 1:pos + k], ' ') AS gram FROM d JOIN p ON p.id = d.id, (SELECT DISTINCT k FROM t) WHERE pos + k <= len(w)),
tp AS (SELECT template, k, slack, its, unnest(range(len(its) - k + 1)) AS place FROM t),
tg AS (SELECT template, k, slack, place, array_to_string(its[place + 1:place + k], ' ') AS gram FROM tp),
v AS (SELECT DISTINCT id, template, slack, pos - place AS diagonal FROM g JOIN tg USING (k, gram)),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, template ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS fresh FROM v),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY id, template ORDER BY diagonal) AS run FROM f),
m AS (SELECT id, template, run, diagonal, unnest(range(len(its))) AS place, unnest(its) AS word FROM r JOIN t USING (template)),
h AS (
  SELECT m.id, template, run, min(diagonal) + min(place) AS first, count(DISTINCT place) AS held
  FROM m JOIN p ON p.id = m.id AND p.pos = m.diagonal + m.place AND p.word = m.word GROUP BY ALL),
s AS (SELECT *, base AND held >= least AS is_base, held >= least AS verified FROM h JOIN t USING (template))
SELECT any_value(doc_id) AS doc_id, any_value(CAST(len(w) AS BIGINT)) AS n_words, count(*) FILTER (is_base) AS n_base,
       CAST(min(first) FILTER (is_base) AS BIGINT) AS first_word, CAST(max(first) FILTER (is_base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels,
       coalesce(max(held / len(its)), 0.0) AS score
FROM d LEFT JOIN s USING (id) GROUP BY id
"""


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": _oracle(TEMPLATES)}
