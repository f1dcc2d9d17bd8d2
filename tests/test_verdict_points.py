"""Cases that once gave wrong numbers: nulls in fits, duplicate mart rows, digests, trimming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import stripped
from rankloom.operators import marts, merge
from rankloom.sources.sinks import dataset_catalog
from rankloom.stats import diagnostics, ranked_logit, regression


def _panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(210):
        x, c = rng.normal(), rng.normal()
        rows.append((None if i % 70 == 69 else "m", None if i % 30 == 29 else f"g{i % 6}", float(x), None if i % 7 == 3 else float(c), float(0.5 * x - c + rng.normal())))
    return spark.createDataFrame(rows, "model string, g string, value double, control double, outcome double"), rows


def _slope(rows):
    used = [r for r in rows if None not in r[1:]]
    groups = sorted({r[1] for r in used})
    x = np.array([[r[2], r[3], *[float(r[1] == g) for g in groups]] for r in used])
    return len(used), np.linalg.lstsq(x, np.array([r[4] for r in used]), rcond=None)[0][0]


def test_null_controls_groups_and_models(spark):
    frame, rows = _panel(spark)
    fits = {r.model: r for r in regression.regression_table(frame, ["model"], "g", ["value", "control"]).collect()}
    mine = [r for r in rows if r[0] == "m"]
    n, slope = _slope(mine)
    assert fits["m"].n == n and fits["m"].dropped == len(mine) - n
    assert fits["m"].beta[0] == pytest.approx(slope, abs=1e-9)
    assert fits["m"].standard_errors[0] > 0
    assert fits[None].n + fits[None].dropped == sum(r[0] is None for r in rows)
    seen = diagnostics.influence_rows(frame.where("model = 'm'"), ["model"], "g", ["value", "control"]).count()
    assert seen == n


def test_two_way_and_joint_with_null_controls(spark):
    frame, rows = _panel(spark)
    wide = frame.where("model = 'm'").withColumn("url", F.pmod(F.xxhash64("value"), F.lit(9)))
    out = regression.two_way_table(wide, ["model"], "g", "url", ["value", "control"]).collect()
    n, slope = _slope([r for r in rows if r[0] == "m"])
    assert out[0].coefficient == pytest.approx(slope, abs=1e-9)
    table = {r.kind: r for r in diagnostics.explainability(wide, "g", {"all": ["value"]}, ["control"]).collect()}
    assert table["single"].n == n == table["joint"].n


def test_duplicate_mart_rows_are_an_error(spark):
    base = spark.sql("SELECT 'r' run_id, 'k' target_keyword_id, 'h' canonical_url_hash, 1 serp_rank")
    mart = spark.sql("SELECT 'r' run_id, 'k' target_keyword_id, 'h' canonical_url_hash, explode(array(1, 2)) AS v")
    assert marts.importance_panel(base, mart.limit(1)).count() == 1
    with pytest.raises(Exception, match="several mart rows"):
        marts.importance_panel(base, mart).collect()


def test_digest_sees_rows_stored_twice(spark):
    one = spark.sql("SELECT 'v1' AS schema_version, 1 AS a")
    two = one.withColumn("a", F.lit(2))
    first, second = (dataset_catalog(x.union(x)).first() for x in (one, two))
    assert first.content_xor == second.content_xor == 0
    assert first.content_sum != second.content_sum


def test_stripped_takes_all_white_space(spark):
    row = spark.range(1).select(*[stripped(F.lit(t)).alias(f"c{i}") for i, t in enumerate(["\tshoes\n", " shoes  ", " "])]).first()
    assert list(row) == ["shoes", "shoes", ""]


def test_mismatching_settings_name_their_runs(spark):
    configs = spark.createDataFrame([("a", 1), ("b", None), ("c", 1)], "source_run string, depth int")
    (row,) = merge.config_mismatches(configs, ["depth"]).collect()
    assert [(v.run, v.value) for v in row.run_values] == [("a", '{"value":1}'), ("b", '{"value":null}'), ("c", '{"value":1}')]


def test_control_constant_in_one_model(spark):
    rng = np.random.default_rng(8)
    rows = [(m, f"{m}{g}", r, float(rng.random()), 1.0 if m == "a" else float(rng.normal())) for m in "ab" for g in range(12) for r in range(1, 7)]
    frame = spark.createDataFrame(rows, "model string, g string, serp_rank int, signal double, control double")
    both = {r.model: r for r in ranked_logit.ranked_logit(frame, ["model"], "g", "signal", ["control"], max_rank=6).collect()}
    alone = ranked_logit.ranked_logit(frame.where("model = 'a'"), ["model"], "g", "signal", max_rank=6).first()
    assert both["a"].status == "computed" and both["a"].omitted_controls == ["control"] and both["b"].omitted_controls == []
    assert both["a"].coefficient == pytest.approx(alone.coefficient, abs=1e-8)
    assert both["a"].standard_error == pytest.approx(alone.standard_error, abs=1e-8)
    assert both["a"].condition_number == pytest.approx(1.0)
