"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams of its lower-cased letters (1 to 3 bytes, words
padded with a blank), weighted by TF-IDF and normalised.  Every language is stood for by
several centroids (spherical k-means over its labelled sample).  The nearest centroid by
cosine gives the language; a text farther from it than nearly all labelled texts of that
language were is rejected.

The classifier is fitted on a bounded sample: at most ``sample`` labelled rows of each
language, those with the smallest hash, and of the ``most_languages`` commonest languages.
Everything after that runs over all rows, whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.words import mixed as spread
from rankloom.llm.words import slices

DIMENSIONS = 1 << 13
#: Label of texts that have no letter at all (or are null).
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    """Fitted centroids: size bounded by languages x clusters x dimensions."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid, normalised
    owner: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine that is accepted, per language


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text; None without letters."""
    letters = _NOT_LETTERS.sub(" ", text or "").strip()
    if not any(map(str.isalpha, letters)):  # what is left may be number signs alone
        return None
    b = np.frombuffer(f" {letters.lower()} ".encode(), dtype=np.uint8).astype(np.uint64)
    two = b[:-1] << np.uint64(8) | b[1:]
    three = two[:-1] << np.uint64(8) | b[2:]
    keys = np.concatenate([b, two | np.uint64(1 << 32), three | np.uint64(1 << 33)])
    return np.bincount((spread(keys) % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def training_rows(docs: DataFrame, may_train: Column, sample: int, most_languages: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(language, text) of the bounded sample, chosen by hash of id and text within each language; equal rows count once."""
    rows = docs.where(may_train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("language"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("language", "text", F.xxhash64("id", "text").alias("draw"))
    common = rows.groupBy("language").count().orderBy(F.col("count").desc(), "language").limit(most_languages).select("language")
    # The cut is found on hashes alone; texts travel only for the rows below it.
    nth = F.row_number().over(Window.partitionBy("language").orderBy("draw"))
    draws = rows.select("language", "draw").distinct().withColumn("nth", nth).where(F.col("nth") <= sample)
    cut = draws.groupBy("language").agg(F.max("draw").alias("cut")).join(common, "language")
    return rows.join(cut, "language").where("draw <= cut").dropDuplicates(["language", "draw"]).select("language", "text")


def fitted(training: DataFrame, clusters: int = 4, rounds: int = 12, slack: float = 0.4) -> Model:
    """Centroids from a bounded table of (language, text).  Vectors are made by the tasks."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [(lang, c) for lang, t in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()) if (c := gram_counts(t)) is not None]
            at = [np.flatnonzero(c) for _, c in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in made], pa.string()), pa.array([i.astype(np.int32).tobytes() for i in at], pa.binary()), pa.array([c[i].astype(np.int32).tobytes() for i, (_, c) in zip(at, made)], pa.binary())],
                names=["language", "at", "n"],
            )

    rows = sorted((r.language, bytes(r.at), bytes(r.n)) for r in training.mapInArrow(vectors, "language string, at binary, n binary").collect())
    languages = sorted({r[0] for r in rows})
    seen = np.zeros(DIMENSIONS)
    for _, at, _ in rows:
        seen[np.frombuffer(at, np.int32)] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    centroids, owner, floor = [], [], []
    for k, language in enumerate(languages):
        own = [r for r in rows if r[0] == language]
        x = np.zeros((len(own), DIMENSIONS), dtype=np.float32)
        for i, (_, at, n) in enumerate(own):
            x[i, np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int32)
        x = _weighted(x, idf.astype(np.float32))
        c = _clustered(x, min(clusters, len(own)), rounds)
        centroids.append(c)
        owner += [k] * len(c)
        # What nearly all labelled texts of the language reach, with some slack.
        floor.append(slack * float(np.quantile((x @ c.T).max(axis=1), 0.02)))
    stacked = np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32)
    return Model(languages, idf.astype(np.float32), stacked, np.array(owner, dtype=np.int64), np.array(floor))


def _clustered(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the rows farthest from those chosen before (no chance involved)."""
    chosen = [int((x @ _unit(x.mean(axis=0))).argmax())]
    while len(chosen) < k:
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[near == j].mean(axis=0)) if (near == j).any() else c[j] for j in range(k)])
    return c


def _verdict(text: str | None, m: Model) -> tuple[str, float, bool]:
    """Nearest centroid's language, its cosine, and whether that is too far."""
    counts = gram_counts(text)
    if counts is None or not m.languages:
        return UNDETERMINED, 0.0, True
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]).astype(np.float32) * m.idf[at]
    cosine = m.centroids[:, at] @ (v / max(float(np.linalg.norm(v)), 1e-12))
    best = int(cosine.argmax())
    k = int(m.owner[best])
    return m.languages[k], min(max(float(cosine[best]), 0.0), 1.0), bool(cosine[best] < m.floor[k])


def verdict_of(text: Column, model: Model) -> Column:
    """Struct of ``lang_pred``, ``score``, ``rejected``.  Only the texts go to Python; the rest of a row stays in the JVM."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [_verdict(t.as_py(), shared.value) for t in texts]
            columns = [pa.array([x[i] for x in made], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "rejected"])

    return judged(text)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (cosine, 0 to 1), ``rejected``: a row for each row of ``docs``.

    Texts without a letter, and all texts if nothing was learned, are ``und`` with score 0
    and rejected.  Ties go to the language that is first by name.  Repeated rows stay.
    """
    judged = docs.select(F.col(id_col).cast("long").alias("doc_id"), verdict_of(F.col(text_col).cast("string"), model).alias("verdict"))
    return judged.select("doc_id", "verdict.*")


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1 (a null id is held out)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identified(docs: DataFrame, sample: int = 1000, most_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows that are not held out, predict all: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    model = fitted(training_rows(docs, ~held_out(F.col(id_col)), sample, most_languages, id_col, text_col, lang_col))
    return predicted(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, sample: int = 1000, most_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    model = fitted(training_rows(docs, ~held_out(F.col(id_col)), sample, most_languages, id_col, text_col, lang_col))
    return docs.where(~verdict_of(F.col(text_col).cast("string"), model)["rejected"])
