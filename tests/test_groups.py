"""Ranks and group statistics: stated rows, and the path for oversized groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import groups, ranks
from rankloom.stats.spearman import adjust_p_values

KEYS = ["run_id", "target_keyword_id"]


def scores(spark, values):
    rows = [("r", "k", v, i, f"u{i}") for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "run_id string, target_keyword_id string, s double, serp_rank int, canonical_url_hash string"
    )


@pytest.mark.parametrize("limit", [None, 1])
@pytest.mark.parametrize(
    "values, rank, pct, z",
    [
        ([0.9, 0.9, 0.4, 0.1], [1.5, 1.5, 3, 4], [1 / 6, 1 / 6, 2 / 3, 1], None),
        ([0.2] * 4, [2.5] * 4, [0.5] * 4, [None] * 4),
        ([0.8, None, 0.2], [1, None, 2], [0, None, 1], [0.7071, None, -0.7071]),
        ([0.5], [1], [None], [None]),
    ],
)
def test_average_ranks(spark, values, rank, pct, z, limit):
    out = ranks.average_ranks(scores(spark, values), {"m": "s"}, group_limit=limit).orderBy("serp_rank").collect()
    assert [r["m_rank"] for r in out] == rank
    assert [r["m_pct"] for r in out] == pytest.approx(pct)
    if z:
        assert [r["m_z"] for r in out] == pytest.approx(z, abs=1e-4)


@pytest.mark.parametrize("limit", [None, 1])
def test_ordinal_ranks(spark, limit):
    out = ranks.ordinal_ranks(scores(spark, [0.9, None, 0.9, 0.1]), {"m": "s"}, group_limit=limit).orderBy("serp_rank").collect()
    assert [r["m_rank"] for r in out] == [1, None, 2, 3]
    assert [r["m_pct"] for r in out] == [0.0, None, 0.5, 1.0]
    one = ranks.ordinal_ranks(scores(spark, [0.3]), {"m": "s"}).first()
    assert (one["m_rank"], one["m_pct"], one["m_z"]) == (1, 0.0, None)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; null keys and ties included."""
    return spark.range(3000).selectExpr(
        "if(id % 3 = 0, if(id % 9 = 0, NULL, id % 7), 99) AS k", "id", "(id * 7919) % 50 AS v", "((id * 104729) % 1000) / 10 AS x"
    ).persist()


def collect(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_running_values_of_oversized_groups(spark, skewed):
    order = [F.col("v").desc(), F.col("id")]
    for kind, value in (("sum", F.lit(1).cast("bigint")), ("min", F.col("x"))):
        whole = groups.group_running(skewed, ["k"], order, value, "out", None, kind)
        cut = groups.group_running(skewed, ["k"], order, value, "out", 100, kind)
        assert collect(whole) == collect(cut)


def test_percentiles_of_oversized_groups(skewed):
    shares = {"a": 0.25, "b": 0.5, "c": 0.9}
    whole = groups.group_percentiles(skewed, ["k"], "x", shares, None).collect()
    cut = {r["k"]: r for r in groups.group_percentiles(skewed, ["k"], "x", shares, 100).collect()}
    for r in whole:
        assert [r[c] for c in shares] == pytest.approx([cut[r["k"]][c] for c in shares])


def test_medians_of_oversized_groups(skewed):
    whole = {r["k"]: r for r in groups.group_medians(skewed, ["k"], ["x", "v"], ["id"], None).collect()}
    for r in groups.group_medians(skewed, ["k"], ["x", "v"], ["id"], 100).collect():
        assert [r[c] for c in ("x", "v", "id")] == pytest.approx([whole[r["k"]][c] for c in ("x", "v", "id")])


def test_false_discovery(spark):
    frame = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.002), ("f", None)], "family string, p_value double")
    for limit in (None, 1):
        out = {r["p_value"]: r["bh_q_value"] for r in adjust_p_values(frame, ["family"], limit=limit).collect()}
        assert out[None] is None
        assert [out[p] for p in (0.01, 0.04, 0.03, 0.002)] == pytest.approx([0.02, 0.04, 0.04, 0.008])


def test_zscore_drops_flat_groups(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 5.0)], "target_keyword_id string, s double")
    assert sorted(r["similarity_z"] for r in ranks.within_group_zscore(frame, "s").collect()) == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert tuple(ranks.dropped_by_zscore(frame, "s").first()) == (3, 5)
    assert np.isclose(ranks.global_zscore(frame, "s").agg(F.sum("z")).first()[0], 0.0)


def test_suffix_sums_are_linear_windows(spark):
    frame = spark.createDataFrame([("k", i, float(i)) for i in (1, 2, 3)], "target_keyword_id string, serp_rank int, x double")
    assert [r["x_suffix"] for r in ranks.suffix_sums(frame, ["x"]).orderBy("serp_rank").collect()] == [6.0, 5.0, 3.0]
