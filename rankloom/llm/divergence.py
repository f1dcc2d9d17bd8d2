"""How far the sources of a language differ in their terms.

Identical texts of a language are collapsed first: one text, with how often each source has it.
Each is tokenised once; its term counts enter every source with that multiplicity, as
occurrences and as documents.  A language keeps the terms of at least ``support`` documents.

A pair of sources is evaluated sparsely.  With p0 the share of a term that a source lacks, the
sum of f over all kept terms is

    sum over a's terms of f(p_a, p0_b) + sum over b's terms of f(p0_a, p_b)
    + (V - |a| - |b|) f(p0_a, p0_b)
    + sum over shared terms of f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f(p0_a, p0_b).

The first lines need only how many terms a source has of each share; the last one only terms
that both have.  Sources are dealt into blocks and terms into buckets of bounded size, and a
task compares two blocks over one bucket.  Partial sums per pair are added up; the result
itself has a row for every ordered pair.

Shares are integers and every division is an exact floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.staging import discarded, stored
from rankloom.llm.words import find_words, slices, word_values

SUPPORT = 10
TOP = 10
#: Sources of a block and terms of a bucket, on average: a task of the comparison holds
#: twice the one times the other.
BLOCK = 64
BUCKET = 256
#: Rows of the bucket table that tells which texts may be copied, at most.
BUCKETS = 1 << 18
SCALE = 1_000_000_000

# Bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F]: letters of ASCII and everything beyond it.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True

_PAIR = "lang string, a string, b string, value long"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text with their counts; ``lang`` and ``places`` pass through."""
    for batch in slices(batches):
        words = find_words(batch.column("text"), True, _LETTERS)
        coded = word_values(words).dictionary_encode()
        n_terms = max(len(coded.dictionary), 1)
        both, counts = np.unique(words.doc * n_terms + coded.indices.to_numpy(), return_counts=True)
        offsets = np.searchsorted(both, np.arange(batch.num_rows + 1) * n_terms)
        terms = coded.dictionary.cast(pa.string()).take(pa.array(both % n_terms))
        struct = pa.StructArray.from_arrays([terms, pa.array(counts.astype(np.int64))], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("places"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), struct)], names=["lang", "places", "terms"])


def term_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` from rows (lang, source, text) without nulls.

    Texts travel only if their name shares a bucket with a copied one; the others are tokenised
    where they are read.  The places of a text are one entry per source that has it, so at most as many as a language
    has sources; the result has the square of that many rows.
    """
    named = rows.withColumn("name", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    times = stored(named.groupBy("lang", "name", "source").agg(F.count("*").alias("times")), "divergence-times")
    copied = times.groupBy("lang", "name").agg(F.sum("times").alias("rows")).where("rows > 1")
    bucket = F.pmod(F.xxhash64("lang", "name"), F.lit(BUCKETS))
    crowded = stored(copied.select(bucket.alias("bucket")).distinct().withColumn("near", F.lit(True)), "divergence-buckets")
    dealt = named.withColumn("bucket", bucket).join(F.broadcast(crowded), "bucket", "left")
    alone = dealt.where("near IS NULL").select("lang", F.array(F.struct("source", F.lit(1).cast("long").alias("times"))).alias("places"), "text")
    texts = dealt.where("near").groupBy("lang", "name").agg(F.any_value("text").alias("text"))
    places = times.groupBy("lang", "name").agg(F.collect_list(F.struct("source", "times")).alias("places"))
    collapsed = alone.unionByName(texts.join(places, ["lang", "name"]).select("lang", "places", "text"))
    tokens = collapsed.mapInArrow(_tokenised, "lang string, places array<struct<source:string,times:bigint>>, terms array<struct<term:string,n:bigint>>")
    each = tokens.select("lang", F.explode("places").alias("p"), "terms").select("lang", "p.source", "p.times", F.explode("terms").alias("t"))
    return each.groupBy("lang", "source", F.col("t.term").alias("term")).agg(F.sum(F.col("t.n") * F.col("times")).alias("n"), F.sum("times").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); 1 where there are no terms."""
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + whole).otherwise(1)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _pairs(lang: str, names: list[str], others: list[str], values: np.ndarray, wanted: np.ndarray) -> pa.Table:
    """Rows (lang, a, b, value) of the wanted places of a matrix; each pair stands with its smaller source first."""
    i, j = np.nonzero(wanted)
    a, b = [names[k] for k in i], [others[k] for k in j]
    swapped = [(y, x) if y.encode() < x.encode() else (x, y) for x, y in zip(a, b)]
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array([x for x, _ in swapped], pa.string()), "b": pa.array([y for _, y in swapped], pa.string()), "value": pa.array(values[i, j], pa.int64())})


def _one_sided(key: tuple, table: pa.Table) -> pa.Table:
    """The part of every pair of two blocks that needs only each source's own shares."""
    lang, low, high = (k.as_py() for k in key)
    rows = table.to_pylist()
    left = [r for r in rows if r["block"] == low]
    right = left if low == high else [r for r in rows if r["block"] == high]

    def crossed(mine: list[dict], others: list[dict]) -> np.ndarray:
        zero = np.array([r["p0"] for r in others], dtype=np.int64)
        out = np.zeros((len(mine), len(others)), dtype=np.int64)
        for k, r in enumerate(mine):
            p = np.array([h["p"] for h in r["shares"]], dtype=np.int64)
            n = np.array([h["n"] for h in r["shares"]], dtype=np.int64)
            for at in range(0, len(p), 8192):
                out[k] += n[at : at + 8192] @ _f(p[at : at + 8192, None], zero[None, :])
        return out

    has = lambda side: np.array([r["here"] for r in side], dtype=np.int64)
    zero = lambda side: np.array([r["p0"] for r in side], dtype=np.int64)
    neither = np.int64(rows[0]["v"]) - has(left)[:, None] - has(right)[None, :]
    values = crossed(left, right) + crossed(right, left).T + neither * _f(zero(left)[:, None], zero(right)[None, :])
    wanted = np.triu(np.ones(values.shape, dtype=bool), 1) if low == high else np.ones(values.shape, dtype=bool)
    return _pairs(lang, [r["source"] for r in left], [r["source"] for r in right], values, wanted)


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """The part of every pair of two blocks that comes from terms of one bucket that both have."""
    lang, low, high, _ = (k.as_py() for k in key)
    sources = table.column("source").combine_chunks().dictionary_encode()
    terms = table.column("term").combine_chunks().dictionary_encode()
    names, who, what = sources.dictionary.to_pylist(), sources.indices.to_numpy(), terms.indices.to_numpy()
    p = np.zeros((len(names), len(terms.dictionary)), dtype=np.int64)
    p[who, what] = table.column("p").to_numpy()
    p0, block = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    p0[who], block[who] = table.column("p0").to_numpy(), table.column("block").to_numpy()
    values, wanted = np.zeros((len(names), len(names)), dtype=np.int64), np.zeros((len(names), len(names)), dtype=bool)
    for a in range(len(names)):
        others = np.arange(a + 1, len(names)) if low == high else np.flatnonzero(block != block[a]) if block[a] == low else np.zeros(0, dtype=np.int64)
        here = np.flatnonzero(p[a])
        i, t = np.nonzero(p[np.ix_(others, here)])
        b, t = others[i], here[t]
        mine, theirs = p[a, t], p[b, t]
        np.add.at(values[a], b, _f(mine, theirs) - _f(mine, p0[b]) - _f(np.full_like(theirs, p0[a]), theirs) + _f(np.full_like(theirs, p0[a]), p0[b]))
        wanted[a, b] = True
    return _pairs(lang, names, names, values, wanted)


def _met(rows: DataFrame) -> DataFrame:
    """Each row once for every block its own is compared with, as the pair ``low``, ``high``."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def pair_values(groups: DataFrame, known: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b`` (a before b), ``value`` of every pair of sources of a language.

    ``groups`` has a row per (lang, source): n_group, here, v; ``known`` its kept terms with n.
    """
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(many, "lang").select(
        "lang", "source", "n_group", "here", "v", "blocks",
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
        share(F.lit(0).cast("long"), F.col("n_group"), F.col("v")).alias("p0"),
    )
    placed = stored(placed, "divergence-blocks")
    terms = known.select("lang", "source", "term", "n").join(placed, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v")))
    shares = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    none = F.array().cast("array<struct<p:bigint,n:bigint>>")
    sided = placed.join(shares, ["lang", "source"], "left").withColumn("shares", F.coalesce("shares", none))
    apart = _met(sided).select("lang", "low", "high", "source", "block", "here", "v", "p0", "shares").groupBy("lang", "low", "high").applyInArrow(_one_sided, _PAIR)
    bucket = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BUCKET)).cast("int").alias("bucket")
    dealt = _met(terms).select("lang", "low", "high", bucket, "source", "term", "block", "p", "p0")
    together = dealt.groupBy("lang", "low", "high", "bucket").applyInArrow(_shared, _PAIR)
    return apart.unionByName(together).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` long, ``rank`` int.

    Null text, language and source are read as ''.  Repeated rows are documents of their own.
    Ties in value rank by the item's bytes.  A language without kept terms has pairs of value 0
    and no term rows; an empty table has no row.  Only the three named columns are read.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = stored(term_counts(rows), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= support).drop("docs")
    known = stored(counts.join(kept, ["lang", "term"]), "divergence-terms")
    discarded(counts)
    sums = known.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("here"))
    langs = known.groupBy("lang", "term").agg(F.any_value("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["n_group", "here", "v", "n_lang"]), "divergence-groups")

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    both = pair_values(groups, known)
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by_value))

    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("total"), F.col("n_lang"), F.col("v"))
    terms = known.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


SQL = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM rows) GROUP BY lang, term HAVING count(*) >= {SUPPORT}),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM rows) JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM rows) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * (coalesce(c.n, 0) + 2)::HUGEINT // (g.total + 2 * s.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sized s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT k.lang, k.term, 1 + {SCALE} * (k.n + 2)::HUGEINT // (t.total + 2 * s.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL) k
  JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM counts GROUP BY lang) t USING (lang) JOIN sized s USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT p.lang, p.source, q.source AS other, sum((p.p - q.p) * (p.p - q.p) // (p.p + q.p)) AS value
    FROM shares p JOIN shares q ON p.lang = q.lang AND p.term = q.term AND p.source <> q.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - w.q) * (s.p - w.q) // (s.p + w.q) AS value
  FROM shares s JOIN whole w USING (lang, term) WHERE s.n > 0 AND s.p > w.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
