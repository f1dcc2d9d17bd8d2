"""Rank correlations of whole lists (F19, F26, F27) against the windows over one row per depth and score."""

import math
import random

from pyspark.sql import functions as F

from rankloom.operators.filters import expand_depths
from rankloom.stats import spearman
from rankloom.stats.moments import melt_signals

DEPTHS = {"top_9": 9, "top_3": 3}


def _frame(spark):
    rng = random.Random(2)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, 1.0, 2.5]
    rows = [(k if k else None, "x" if k % 2 else None, r, rng.choice(odd), 7.0 if k % 4 == 0 else rng.random()) for k in range(40) for r in [*range(0, rng.randint(1, 12)), None]]
    rows += [(99, "tied", 1, 1.0, 2.0), (99, "tied", 1, 2.0, 1.0), (99, "tied", 2, 3.0, 3.0)]
    return spark.createDataFrame(rows, "k long, l string, serp_rank long, a double, b double")


def test_lists_give_what_windows_give(spark):
    frame = _frame(spark)
    melted = melt_signals(expand_depths(frame, DEPTHS), ["a", "b"], ["rank_depth", "k", "l", "serp_rank"])
    by_window = spearman.keyword_correlations(melted, ["rank_depth", "signal", "k", "l"], "value")
    by_list = spearman.list_correlations(frame, ["k", "l"], ["a", "b"], DEPTHS)
    assert by_list.columns == by_window.columns
    one, other = ({tuple(r)[:4]: tuple(r)[4:] for r in f.collect()} for f in (by_window, by_list))
    assert one.keys() == other.keys() and len(one) > 100
    for key, (n, rho, p) in one.items():
        assert other[key][0] == n and abs(other[key][1] - rho) < 1e-12 and abs(other[key][2] - p) < 1e-9, key


def test_rows_travel_once(spark):
    """Before, every depth and score had rows of its own in the shuffle, sorted for four windows."""
    plan = spearman.list_correlations(_frame(spark), ["k", "l"], ["a", "b"], DEPTHS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Generate" not in plan


def test_slices_of_batches(spark):
    """Lists of very different length in one batch, cut into steps."""
    rows = spark.range(3000).select((F.col("id") % 7 * F.col("id") % 50).alias("k"), (F.col("id") % 60 + 1).alias("serp_rank"), F.hash("id").cast("double").alias("a"))
    old = spearman.keyword_correlations(rows.where("serp_rank <= 50"), ["k"], "a").select("k", "n_rows", F.round("rho", 9)).collect()
    new = spearman.list_correlations(rows, ["k"], ["a"], {"d": 50}).select("k", "n_rows", F.round("rho", 9)).collect()
    assert sorted(map(tuple, old)) == sorted(map(tuple, new))


def test_long_rows_stay_with_their_list(spark):
    """rows that lie together by list are grouped by model and list without another shuffle."""
    long = melt_signals(expand_depths(_frame(spark), DEPTHS).repartition("k"), ["a", "b"], ["rank_depth", "k"])
    frame = long.groupBy("rank_depth", "signal", "k").agg(F.sum("value"))
    frame.collect()
    assert frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_bundle_ranks_no_long_rows(spark, monkeypatch):
    """the bundle takes its correlations from lists, also where a depth is left out and a control is missing."""
    from rankloom.stats import bundle

    rng = random.Random(4)
    rows = [(k, r, rng.random(), None if (k + r) % 5 == 0 else rng.random()) for k in range(15) for r in range(1, 9)]
    panel = spark.createDataFrame(rows, "k long, serp_rank long, a double, c double")
    seen = []
    whole = bundle.summarize_correlations
    monkeypatch.setattr(bundle, "summarize_correlations", lambda tests, *rest: seen.append(tests) or whole(tests, *rest))
    depths = {"top_8": 8, "top_1": 1}
    bundle.association_table(panel, ["a"], ["c"], "k", depths)
    melted = bundle.long_panel(panel, ["a"], ["c"], "k", depths).where("rank_depth = 'top_8'")
    expected = spearman.keyword_correlations(melted, ["rank_depth", "signal", "k"], "value")
    assert sorted((r[0], r[1], round(r.rho, 9)) for r in seen[0].collect()) == sorted((r[0], r[1], round(r.rho, 9)) for r in expected.collect())
    assert seen[0].columns == ["rank_depth", "signal", "rho"]
