"""Cases from the third round of findings."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.importance import bootstrap, crossval
from rankloom.operators import groups, ranks
from rankloom.plans.registry import registered
from rankloom.stats import ranked_logit


def test_percentiles_of_a_column_called_n(spark):
    """the path for oversized groups must not add names that the ranked column may have."""
    for name in ("n", "first", "last"):
        rows = spark.range(9).select(F.lit(1).alias("g"), F.col("id").alias(name))
        assert [tuple(r) for r in groups.group_percentiles(rows, ["g"], name, {"middle": 0.5}, limit=3).collect()] == [(1, 4.0)]


def test_pages_that_share_a_url(spark, tmp_path):
    """every page has its markup, also where two pages have one URL."""
    pages = {"page_id": [1, 2, 7], "url": ["http://a.example/x", "http://a.example/x", "http://b.example/"], "html": ["<p>a</p>", " <p>b</p>\n", "<p>c</p>"]}
    pq.write_table(pa.table(pages), tmp_path / "pages.parquet")
    fn, sql = registered()["page_html"]
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    assert sorted(tuple(r) for r in fn(spark, str(tmp_path)).collect()) == sorted(con.execute(sql).fetchall())


def _panel(spark, lists=12, depth=6):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(lists):
        for r in range(1, depth + 1):
            a, b = rng.normal() - 0.3 * r, round(float(rng.normal()), 1)
            rows.append((f"k{k}", r, f"u{k}-{r}", f"d{(k + r) % 5}", float(a), None if (k + r) % 7 == 0 else b))
    return spark.createDataFrame(rows, "k string, r int, id string, d string, a double, b double")


def test_quality_without_the_long_predictions(spark):
    """The sums of the lists give what the long table gives, and no row is moved for them."""
    for unit in (None, "d"):
        cv = crossval.cross_validate(_panel(spark), {"one": ["a"], "two": ["b"]}, "k", "r", unit, "id", (), 3, 2)
        identity = ["k", "r", "id", *(["d"] if unit else [])]
        expected = (
            crossval.prediction_quality(cv.predictions, ["repeat"], "k", "r", "id"),
            crossval.prediction_quality(crossval.averaged(cv.predictions, identity), [], "k", "r", "id"),
        )
        for long, per_repeat in zip(expected, (True, False)):
            keys = ["repeat", "factor"] if per_repeat else ["factor"]
            got = {tuple(r[c] for c in keys): r for r in crossval.validated_quality(cv, per_repeat).collect()}
            found = long.collect()
            assert len(got) == len(found) == (4 if per_repeat else 2)
            for r in found:
                for c in ("full_r2", "reduced_r2", "full_ndcg", "reduced_ndcg"):
                    assert got[tuple(r[k] for k in keys)][c] == pytest.approx(r[c], abs=1e-9)
        assert "Exchange" not in cv.lists()._jdf.queryExecution().executedPlan().toString()


def test_intervals_without_the_long_predictions(spark):
    """weights meet lists or units; the draws and the intervals are those of the long table."""
    for unit in (None, "d"):
        cv = crossval.cross_validate(_panel(spark), {"one": ["a"], "two": ["b"]}, "k", "r", unit, "id", (), 3, 2)
        got = {(r.factor, r.metric): r for r in bootstrap.validated_intervals(cv, unit, 40).collect()}
        long = bootstrap.bootstrap_intervals(cv.predictions, ["one", "two"], 2, "k", "r", "id", unit, 40).collect()
        assert len(got) == len(long) == (2 if unit else 4)
        for r in long:
            mine = got[r.factor, r.metric]
            assert mine.draws == r.draws
            assert (mine.lower, mine.upper) == pytest.approx((r.lower, r.upper), abs=1e-9)


def test_bounded_ranks_move_rows_once(spark):
    """moments and ranks of bounded groups share one exchange; few domains are not shuffled for."""
    rows = _panel(spark)
    plan = ranks.ordinal_ranks(rows, {"m": "a", "n": "b"}, ["k"], ["r", "id"], None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    lookup = rows.groupBy("d").agg(F.max("a").alias("top"))
    small, large = (groups.join_measured(rows, lookup, ["d"], "left", limit) for limit in (100, 1))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_newton_steps_do_not_shuffle_rows(spark):
    """lists are stored as one row each; a step adds up in the tasks, and rank 1 can be left out of the same lists."""
    rows = _panel(spark).select(F.lit("m").alias("m"), "k", "r", "a", F.coalesce("b", F.lit(0.0)).alias("b"))
    lists = ranked_logit.prepare_lists(rows, ["m"], "k", "a", ["b"], "r", 6)
    assert lists.count() == 12
    step = ranked_logit.newton_terms(lists, ["m"], "k", {("m",): [0.1, -0.2]}, 2)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan and "hashpartitioning(m" not in plan
    loglik, gradient = 0.0, np.zeros(2)
    data = {}
    for r in rows.collect():
        data.setdefault(r.k, []).append((r.r, r.a, r.b))
    for items in data.values():
        x = np.array([[np.sign(a) * np.log1p(abs(a)), b] for _, a, b in sorted(items)])
        for i in range(len(x)):
            w = np.exp(x[i:] @ [0.1, -0.2])
            loglik += x[i] @ [0.1, -0.2] - np.log(w.sum())
            gradient += x[i] - (w[:, None] * x[i:]).sum(axis=0) / w.sum()
    got = step.first()
    assert got.loglik == pytest.approx(loglik) and got.gradient == pytest.approx(list(gradient))
    alone = ranked_logit.ranked_logit(rows.where("r > 1"), ["m"], "k", "a", ["b"], "r", 6, without_top=False).first()
    both = ranked_logit.ranked_logit(rows, ["m"], "k", "a", ["b"], "r", 6).first()
    assert both.log_odds_without_top / both.signal_sd == pytest.approx(alone.coefficient, abs=1e-6)


def test_oversized_groups_are_not_shuffled_by_their_keys(spark):
    """rows of an oversized group must not meet in one task for being compared with the list of such groups."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.lit("s").alias("g"), (F.col("id") % 2).alias("h"), F.col("id").cast("double").alias("v"))
        out = groups.group_running(rows, ["h"], [F.col("v")], F.lit(1), "upto", limit=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert out.where("upto = 500").count() == 2
        found = groups.group_percentiles(rows, ["h"], "v", {"m": 0.5}, limit=100)
        assert sorted(map(tuple, found.collect())) == [(0, 499.0), (1, 500.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
