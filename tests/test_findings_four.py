"""Points of the fourth round of findings."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.importance import crossval, report

FACTORS = {"one": ["a"], "two": ["b"]}


def lists_frame(spark, lists=12, odd=False):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(lists):
        for r in range(1, 7):
            a = float(rng.normal() - math.log(r))
            b = None if (k + r) % 5 == 0 else float(rng.integers(0, 3))
            if odd and k < 4:
                a, b = (float("nan") if r == 2 else 1.0 if r > 2 or k else 2.0), (None if r > 1 else 0.0)
            rows.append((f"k{k}", r, f"row{k}-{r}", f"d{(k * 3 + r) % 5}", a, b))
    names = "target_keyword_id string, serp_rank int, canonical_url_hash string, domain string, a double, b double"
    return spark.createDataFrame(rows, names)


def test_relative_importance_makes_its_panel_once(spark):
    """screening, both validations and their intervals read rows that were made and written once."""
    frame = lists_frame(spark)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    panel = frame.mapInPandas(counted, frame.schema)
    out = report.relative_importance(panel, FACTORS, domain="domain", controls=(), folds=3, repeats=2, draws=10, permutations=10, domain_repeats=2)
    assert sorted(r["factor"] for r in out.collect()) == ["one", "two"]
    assert made.value == frame.count()


@pytest.mark.parametrize("unit", [None, "domain"])
def test_qualities_come_from_one_pass(spark, unit):
    cv = crossval.cross_validate(lists_frame(spark), FACTORS, unit=unit, folds=3, repeats=2)
    together = crossval.validated_qualities(cv)
    for got, per_repeat in zip(together, (False, True)):
        want = crossval.validated_quality(cv, per_repeat)
        keys = ["repeat", "factor"] if per_repeat else ["factor"]
        a, b = (f.toPandas().sort_values(keys).reset_index(drop=True) for f in (got, want))
        pd.testing.assert_frame_equal(a, b[a.columns])


@pytest.mark.parametrize("unit", ["target_keyword_id", "domain"])
def test_fold_sums_count_what_varies(spark, unit):
    """lists tell in their tasks in how many keywords a column varies, as minimum and maximum over exploded rows do."""
    frame = lists_frame(spark, odd=True)
    cells = crossval.assign_folds(frame, unit, 3, 2)
    rows = frame.join(cells, unit).withColumn("outcome", F.lit(0.0))
    lists = rows.groupBy("target_keyword_id").agg(F.collect_list(F.struct("outcome", "a", "b", "cells")).alias("items"))
    layout = crossval.Layout(["a", "b"], FACTORS, 3, crossval.INNER, 2, np.zeros(2))
    matrices, got = crossval.fold_sums(lists, layout)
    long = rows.select("target_keyword_id", "a", "b", F.posexplode("cells").alias("repeat", "code")).withColumn("fold", F.floor(F.col("code") / crossval.INNER))
    for repeat in range(2):
        for test in range(3):
            train = long.where(f"repeat = {repeat} AND fold <> {test}").groupBy("target_keyword_id")
            per_key = train.agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(c) for c in "ab"]).collect()
            assert got[repeat, test, "__keys"] == len(per_key)
            for c in "ab":
                assert got[repeat, test, c] == sum(r[c] for r in per_key)
    ones = sum(m[4, 4] for cell, m in matrices.items() if cell < 9)
    assert ones == frame.count()


def test_few_domains_are_broadcast(spark):
    """rows are not shuffled by their domain, of which one may hold a third of them."""
    frame = lists_frame(spark).repartition(4)
    made = []
    join = type(frame).join

    def watched(self, other, *rest):
        made.append((rest[0], other._jdf.queryExecution().optimizedPlan().toString().startswith("ResolvedHint") or "broadcast" in other._jdf.queryExecution().logical().toString()))
        return join(self, other, *rest)

    type(frame).join = watched
    try:
        crossval.cross_validate(frame, FACTORS, unit="domain", folds=3, repeats=1)
    finally:
        type(frame).join = join
    assert ("domain", True) in made


def small_tables(folder, lines=3000, parts=60, suppliers=7):
    """Line items and parts as Parquet: one supplier has a third of the rows, a tenth of the rows has none."""
    rng = np.random.default_rng(5)
    supplier = np.where(rng.random(lines) < 0.33, 0, rng.integers(0, suppliers, lines))
    lineitem = pd.DataFrame(
        {
            "l_orderkey": np.arange(lines) // 4, "l_partkey": rng.integers(0, parts, lines),
            "l_suppkey": pd.array(np.where(rng.random(lines) < 0.1, None, supplier), dtype="Int64"), "l_linenumber": (np.arange(lines) % 4 + 1).astype("int32"),
            "l_quantity": rng.integers(1, 51, lines).astype(float), "l_extendedprice": rng.integers(100, 9999, lines).astype(float),
            "l_discount": rng.integers(0, 11, lines) / 100, "l_tax": rng.integers(0, 9, lines) / 100,
        }
    )
    part = pd.DataFrame(
        {
            "p_partkey": np.arange(parts), "p_name": [f"part {i}" for i in range(parts)], "p_brand": [f"Brand#{i % 5}" for i in range(parts)],
            "p_type": rng.choice(["SMALL", "LARGE"], parts), "p_size": rng.integers(1, 51, parts).astype("int32"), "p_retailprice": 900.0 + np.arange(parts),
        }
    )
    lineitem.to_parquet(f"{folder}/lineitem.parquet")
    part.to_parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["analysis_mart", "backlinks_analysis", "onpage_mart"])
def test_marts_keep_no_shuffle(spark, tmp_path, name):
    """the result is written once, and what its joins shuffled is of no more use when it is read."""
    from rankloom.plans import marts

    out = getattr(marts, name)(spark, small_tables(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Scan parquet" in plan
    assert out.count() > 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_lists_dealt_out_are_joined_as_they_lie(spark):
    """joins on the page and windows over lists move the rows of each table once."""
    from rankloom.operators import marts as M
    from rankloom.session import shared_partitions

    page = spark.range(2000).selectExpr(
        "'r' AS run_id", "concat('k', id % 100) AS target_keyword_id", "concat('h', id) AS canonical_url_hash", "id AS page_id", "'p' AS response_id",
        "id AS page_text_length", *[f"double(id % 7) AS {c}" for c in M.SCORE_COLUMNS], "concat('https://a/', id) AS url",
    )
    serp = page.selectExpr("run_id", "target_keyword_id", "canonical_url_hash", "url", "page_id DIV 100 + 1 AS serp_rank", "'v' AS schema_version")
    onpage = page.selectExpr(*M.PAGE_KEY, "page_id % 2 = 0 AS deprecated_html_tags", "page_id AS time_to_first_byte_ms")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [M.by_list(f) for f in (serp, page.drop("url"), onpage)]
        with shared_partitions(spark):
            plan = M.analysis_mart(*frames)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 3 and all("hashpartitioning(target_keyword_id#" in line and "canonical_url_hash" not in line for line in moved)


def test_stored_columns_keep_values_and_types(spark):
    from rankloom.session import store_columns

    frame = spark.sql("SELECT * FROM VALUES (1L, 'a', CAST(NULL AS DOUBLE), array(1, NULL), true), (2L, NULL, double('NaN'), NULL, NULL) t(`a b`, c, d, e, f)")
    kept = store_columns(frame)
    assert kept.dtypes == frame.dtypes
    assert sorted(map(str, kept.collect())) == sorted(map(str, frame.collect()))
    empty = store_columns(spark.sql("SELECT 1 AS a, NULL AS nothing"))
    assert empty.dtypes == [("a", "int"), ("nothing", "void")] and empty.count() == 1
