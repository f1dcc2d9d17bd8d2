"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.staging import discarded, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of the edges (a, b).

    Rounds of two steps: every node hands its larger neighbours to the smallest node it
    knows, then its smaller ones.  The depth shrinks geometrically; nothing is collected but
    the number of edges that are not yet stars.  A node with a third of all edges is grouped
    by partial minimum only.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), name)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = stored(small.where("a <> b").distinct(), name)
        changed = after.join(pairs, ["a", "b"], "left_anti").limit(1).count() or pairs.join(after, ["a", "b"], "left_anti").limit(1).count()
        discarded(pairs, large)
        pairs = after
        if not changed:
            break
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
