"""License scan by diagonal voting.

Every text's rolling word k-grams are named by 64-bit hashes and joined, all of them, with the
gram positions of the license templates (a literal table of fixed size, so it is broadcast).  A
hit at word ``i`` of the text and word ``j`` of the template votes for the diagonal ``i - j``.
Votes are aggregated by (text, template, diagonal); diagonals not further apart than the
template's slack are merged, so that inserted or left-out words do not break a span.  Spans are
then verified word by word in the text; a verified span's share is the part of the template's
words that its grams cover.

Phrases are templates too, with grams of two words, no slack and a share of 1: their verified
spans are exactly the places where their words stand consecutively.

Only texts with a merged diagonal travel to their verification, preselected by a table of key
buckets of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.staging import row_key, stored
from rankloom.llm.words import chained, find_words, mixed, slices

#: Grams of one row at most; longer texts give several rows.
CHUNK = 1 << 16
#: Rows of the bucket table that preselects texts, at most.
BUCKETS = 1 << 18

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# Bytes of that class after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_HIT = "array<struct<template:int,members:array<struct<diagonal:bigint,js:array<int>>>>>"
_SPANS = "array<struct<template:int,start:bigint,end:bigint,share:double>>"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    gram: int = 2
    slack: int = 0
    least: float = 1.0

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


def _body(label: str, text: str) -> Template:
    return Template(label, text, gram=4, slack=8, least=0.6)


# The phrases that are searched for, and the opening paragraphs of public license texts.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("agpl", "gnu affero general public license"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("bsd", "bsd license"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("epl", "eclipse public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl", "mozilla public license"),
    _body(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    _body(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    _body(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    _body(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    _body(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    _body(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _gram_names(texts: pa.Array, k: int, words=None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the k-grams of each text, and where each text's begin (and the last ends)."""
    words = words or find_words(texts, True, _IS_WORD)
    one = words.names(1)
    n = len(one) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(words.first), np.int64)
    names = np.full(n, k, dtype=np.uint64)
    for step in range(k):
        names = chained(names, one[step : step + n])
    inside = words.doc[:n] == words.doc[k - 1 :]
    offsets = np.concatenate([[0], np.cumsum(np.maximum(np.diff(words.first) - k + 1, 0))])
    return mixed(names[inside]).view(np.int64), offsets


def _gram_rows(sizes: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = find_words(batch.column("text"), True, _IS_WORD)
            for k in sizes:
                names, offsets = _gram_names(batch.column("text"), k, words)
                long = np.flatnonzero(np.diff(offsets) > CHUNK)
                cuts = np.unique(np.concatenate([offsets, *[np.arange(offsets[d], offsets[d + 1], CHUNK) for d in long]]))
                if len(cuts) < 2:
                    continue
                doc = np.searchsorted(offsets, cuts[:-1], side="right") - 1
                grams = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(names))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(cuts[:-1] - offsets[doc], pa.int64()), grams], names=["key", "at", "grams"])

    return run


def template_grams(templates: Sequence[Template]) -> list[tuple[int, int, int, int]]:
    """(name, template, position, slack) of every gram of every template."""
    out = []
    for number, t in enumerate(templates):
        names, _ = _gram_names(pa.array([t.text]), t.gram)
        out += [(name, number, j, t.slack) for j, name in enumerate(names.tolist())]
    return out


def merged_diagonals(rows: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``key``, ``hits``: the merged diagonals of every template that has votes in a text."""
    spark = rows.sparkSession
    grams = rows.select("key", "text").mapInArrow(_gram_rows(sorted({t.gram for t in templates})), "key string, at long, grams array<long>")
    # One row per gram of the templates, whatever the size of the corpus.
    known = F.broadcast(spark.createDataFrame(template_grams(templates), "gram long, template int, j int, slack int"))
    places = grams.select("key", "at", F.posexplode("grams").alias("i", "gram"))
    votes = places.join(known, "gram").select("key", "template", "slack", (F.col("at") + F.col("i") - F.col("j")).alias("diagonal"), "j")
    diagonals = votes.groupBy("key", "template", "slack", "diagonal").agg(F.collect_set("j").alias("js"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")).cast("int"), F.lit(1))
    runs = diagonals.withColumn("new", apart).withColumn("run", F.sum("new").over(along))
    spans = runs.groupBy("key", "template", "run").agg(F.collect_list(F.struct("diagonal", "js")).alias("members"))
    return spans.groupBy("key").agg(F.collect_list(F.struct("template", "members")).alias("hits"))


def _verified(templates: Sequence[Template]):
    known = [(t.words, t.gram) for t in templates]

    def spans_of(text: str, hits: list[dict]) -> list[dict]:
        words, out = words_of(text), []
        for hit in hits:
            mine, k = known[hit["template"]]
            covered: set[int] = set()
            start, end = len(words), 0
            for member in hit["members"]:
                for j in member["js"]:
                    i = member["diagonal"] + j
                    if words[i : i + k] == mine[j : j + k]:
                        covered.update(range(j, j + k))
                        start, end = min(start, i), max(end, i + k)
            if covered:
                out.append({"template": hit["template"], "start": start, "end": end, "share": len(covered) / len(mine)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole]):
                spans = [spans_of(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())]
                kind = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind)], names=["key", "found"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = find_words(batch.column("text"), True, _IS_WORD)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.diff(words.first), pa.int64())], names=["doc_id", "key", "n_words"])


def scanned(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words`` long and ``spans`` (array of template, start,
    end, share: verified spans in words, end exclusive, ordered; those below their template's least share too).

    Null texts are empty.  Repeated rows stay, each with the same spans.  An empty table has no
    row.  Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    hits = stored(merged_diagonals(rows, templates), "license-diagonals")
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    near = rows.select("key", "text", bucket).join(F.broadcast(hits.select(bucket).distinct()), "bucket", "left_semi").select("key", "text")
    texts = near.join(hits.select("key"), "key", "left_semi").dropDuplicates(["key"])
    found = texts.join(hits, "key").mapInArrow(_verified(templates), f"key string, found {_SPANS}")
    found = found.select("key", F.array_sort("found").alias("spans"))
    counted = rows.select("doc_id", "key", "text").mapInArrow(_counted, "doc_id long, key string, n_words long")
    return counted.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def digest(result: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """The columns of the registered query; ``score`` is the largest share of any verified span."""
    labels, base, least = (F.array(*[F.lit(v) for v in values]) for values in ([t.label for t in templates], [t.base for t in templates], [t.least for t in templates]))
    whole = F.filter("spans", lambda s: s["share"] >= F.get(least, s["template"]))
    result = result.withColumn("whole", whole).withColumn("places", F.filter("whole", lambda s: F.get(base, s["template"])))

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.get(labels, s["template"])))), ",")

    starts = F.transform("places", lambda s: s["start"])
    return result.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("places")).alias("base_labels"),
        joined(F.col("whole")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def _sql(templates: Sequence[Template]) -> str:
    given = ", ".join(f"({n}, '{t.label}', {t.base}, {t.gram}, {t.slack}, {t.least}::DOUBLE, '{t.text}')" for n, t in enumerate(templates))
    words = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH templates AS MATERIALIZED (
SELECT *, {words.format(text="text")} AS words FROM (VALUES {given}) t(template, label, base, gram, slack, least, text)),
grams AS MATERIALIZED (
SELECT template, gram AS k, slack, j - 1 AS j, array_to_string(words[j : j + gram - 1], ' ') AS name
FROM (SELECT *, unnest(range(1, len(words) - gram + 2)) AS j FROM templates)),
rows AS MATERIALIZED (
SELECT row_number() OVER () AS row, doc_id, {words.format(text="coalesce(text, '')")} AS words FROM documents),
places AS (
SELECT row, k, i - 1 AS i, array_to_string(words[i : i + k - 1], ' ') AS name
FROM (SELECT row, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM rows, (SELECT DISTINCT k FROM grams))),
votes AS MATERIALIZED (SELECT row, template, slack, i - j AS diagonal, j, k FROM places JOIN grams USING (k, name)),
runs AS MATERIALIZED (
SELECT row, template, diagonal, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS run FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS new
  FROM (SELECT DISTINCT row, template, slack, diagonal FROM votes))),
spans AS MATERIALIZED (
SELECT row, template, run, min(diagonal + p) AS start, count(DISTINCT p) AS covered
FROM (SELECT row, template, run, diagonal, unnest(range(j, j + k)) AS p FROM votes JOIN runs USING (row, template, diagonal)) GROUP BY ALL),
found AS (
SELECT s.row, s.start, s.covered / len(t.words) AS share, t.label, t.base, t.least FROM spans s JOIN templates t USING (template))
SELECT r.doc_id, len(r.words)::BIGINT AS n_words,
  count(*) FILTER (share >= least AND base) AS n_base,
  (min(start) FILTER (share >= least AND base))::BIGINT AS first_word,
  (max(start) FILTER (share >= least AND base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= least AND base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= least), '') AS labels,
  coalesce(max(share), 0.0)::DOUBLE AS score
FROM rows r LEFT JOIN found USING (row) GROUP BY r.row, r.doc_id, r.words"""


SQL = _sql(TEMPLATES)
