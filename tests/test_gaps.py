"""Version check, missing scores, score report of single pages."""

import pytest

from rankloom.operators import similarity
from rankloom.operators.merge import require_one_version
from rankloom.operators.quality import ContractError
from rankloom.operators.ranks import score_report


def test_one_version(spark):
    frame = spark.createDataFrame([("v1", 1), ("v1", 2)], "schema_version string, x int")
    assert require_one_version(frame) is frame
    with pytest.raises(ContractError, match="v1 and v2"):
        require_one_version(frame.unionByName(spark.createDataFrame([("v2", 3)], frame.schema)))


def test_a_missing_score_is_an_error(spark):
    names = [f"a_{k}_score" for k in ("raw", "normalized")]
    frame = spark.createDataFrame([("k", "u", 1.0, 0.5), ("k", "w", 0.0, None)], f"target_keyword string, url string, {names[0]} double, {names[1]} double")
    assert similarity.require_scores(frame.where("url = 'u'"), ["a"]).count() == 1
    with pytest.raises(ContractError, match="k w: no a_normalized_score"):
        similarity.require_scores(frame, ["a"])


def test_score_report(spark):
    frame = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 3.0), ("k", "c", 3.0), ("k", "d", None), ("one", "x", 2.0)], "target_keyword string, url string, s double")
    got = {(r.target_keyword, r.url): (r["rank"], r.percentile) for r in score_report(frame, "s").collect()}
    assert got == {("k", "b"): (1, 0.0), ("k", "c"): (2, 0.5), ("k", "a"): (3, 1.0), ("one", "x"): (1, 0.0)}
