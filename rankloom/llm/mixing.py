"""Mixing sources to target weights by hash thresholds.

Every document gets a 48-bit hash of its content.  Sizes are summed by source and hash
bucket; the running sum over at most 4,096 buckets of a source shows in which bucket its
budget ends, and only that bucket is split again, level by level.  The result is one
threshold per source: documents below it are taken once more.  Nothing is sorted, budgets
are nested (a larger budget takes a superset), and reruns agree.

Only built-in functions are used.  Sums are partial before every shuffle, so a source with
a third of all rows is a few thousand rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.staging import row_key, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of one level, and levels: 48 bits tell documents apart.
BITS, LEVELS = 12, 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def content_hash(doc_id: Column, text: Column) -> Column:
    return F.conv(F.substring(row_key(doc_id, text), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source.

    Sources by code point, null last, take the weights in turn and share all sizes.  A
    target stops at ``most`` times its source; what is left goes to the others by weight.
    Filling sources by the level at which they are full gives that share in one pass.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1)).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("level", (everything - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(onward)).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at"))
    whole = Window.partitionBy(F.lit(1))
    level = F.min_by("level", fits).over(whole)
    return rows.withColumn("final", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.lit(0.0))).alias("target"))


def thresholds(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``whole`` (times every document is taken) and
    ``below`` (documents with a smaller hash are taken once more), one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(totals, weights, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = stored(goals.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    # The bucket in which each source's budget ends, as the hash prefix of all levels so far.
    edge = goals.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("used"))
    for level in range(1, LEVELS + 1):
        bound = edge.select(F.col("source").alias("edge_source"), "budget", "prefix", "used")
        inside = sizes.join(bound, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("hash", BITS * (LEVELS - level + 1)) == F.col("prefix")))
        buckets = inside.groupBy("source", "budget", "used", F.expr(f"shiftright(hash, {BITS * (LEVELS - level)})").alias("bucket")).agg(F.sum("size").alias("sum"))
        running = buckets.withColumn("upto", F.col("used") + F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
        ends = running.where(F.col("upto") > F.col("budget")).groupBy("source", "budget").agg(F.min("bucket").alias("prefix"), F.min_by(F.col("upto") - F.col("sum"), "bucket").alias("used"), F.min_by("upto", "bucket").alias("upto"))
        edge = stored(ends, f"mix-level-{level}")
    # The last bucket is one document (or equal rows): it is taken if that comes nearer to the budget.
    nearer = (F.col("upto") - F.col("budget") < F.col("budget") - F.col("used")).cast("long")
    last = edge.select(F.col("source").alias("edge_source"), (F.col("prefix") + nearer).alias("below"))
    return goals.join(last, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(1 << (BITS * LEVELS))).alias("below")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    A null text has size 0.  A null source is a source of its own, last in order.  Rows
    equal in id and text share a hash and are taken alike.  Other columns are not read.
    """
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size_of(F.col(text_col)).alias("size"),
        content_hash(F.col(id_col).cast("long"), F.col(text_col)).alias("hash"),
    )
    sizes = stored(sizes, "mix-sizes")
    return _applied(sizes, thresholds(sizes, weights, most)).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _applied(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    bound = stored(goals, "mix-thresholds").withColumnRenamed("source", "goal_source")
    copies = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    return sizes.join(bound, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("copies", copies)


def resampled(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` itself, every row as often as the mix takes it (repeats are equal rows)."""
    key = F.struct(content_hash(F.col(id_col).cast("long"), F.col(text_col)).alias("hash"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    sizes = stored(rows.select("k.*"), "mix-sizes")
    goals = _applied(rows.select("row", "k.*"), thresholds(sizes, weights, most)).where(F.col("copies") > 0)
    return goals.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("turn")).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce('t' || text, 'null')), 1, 12))::BIGINT AS hash
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s
), l AS (
  SELECT *, row_number() OVER o AS nth,
    ((SELECT sum(source_size) FROM s)::DOUBLE - (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, nth) FROM l WHERE level * weight <= cap) * weight, 0.0)) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), r AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, hash) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, whole + extra AS copies, size * (whole + extra) AS taken
FROM (SELECT *, (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)))::BIGINT AS extra FROM r)
"""
