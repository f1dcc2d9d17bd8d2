"""Statistics against direct NumPy computation with the full dummy design."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import dist
from rankloom.operators.marts import authority_proxy, entity_signals, site_scale
from rankloom.stats import bundle, diagnostics, entities, ranked_logit, regression, spearman


def make_panel(keywords=7, ranks=9, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keywords):
        for r in range(1, ranks + 1 - k % 3):
            x, c = rng.normal() + k, rng.normal()
            rows.append((f"k{k}", f"u{rng.integers(0, 12)}", r, x, c, 0.4 * x - 0.2 * c + rng.normal() - math.log(r)))
    return pd.DataFrame(rows, columns=["k", "u", "serp_rank", "x", "c", "y"])


@pytest.fixture(scope="module")
def panel():
    return make_panel()


@pytest.fixture(scope="module")
def frame(spark, panel):
    return spark.createDataFrame(panel.assign(m="m")).persist()


def dummy_fit(p, columns=("x", "c"), y="y"):
    x = np.column_stack([*(p[c] for c in columns), pd.get_dummies(p["k"]).to_numpy(float)])
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ p[y].to_numpy()
    e = p[y].to_numpy() - x @ b
    return x, inverse, b, e


def cluster_cov(x, inverse, e, codes):
    s = np.array([x[codes == g].T @ e[codes == g] for g in np.unique(codes)])
    g, (n, k) = len(s), x.shape
    return inverse @ s.T @ s @ inverse * g / (g - 1) * (n - 1) / (n - k)


def test_regression(frame, panel):
    r = regression.regression_table(frame, ["m"], "k", ["x", "c"], "y").first()
    x, inverse, b, e = dummy_fit(panel)
    n, k = x.shape
    tss = ((panel["y"] - panel["y"].mean()) ** 2).sum()
    assert r["beta"] == pytest.approx(b[:2])
    assert r["r_squared"] == pytest.approx(1 - e @ e / tss)
    assert r["adjusted_r_squared"] == pytest.approx(1 - (e @ e / tss) * (n - 1) / (n - k))
    assert r["aic"] == pytest.approx(n * (math.log(2 * math.pi) + math.log(e @ e / n) + 1) + 2 * k)
    v = cluster_cov(x, inverse, e, panel["k"].to_numpy())
    assert r["standard_errors"] == pytest.approx(np.sqrt(np.diag(v))[:2])
    assert r["inference_df"] == panel["k"].nunique() - 1
    base = dummy_fit(panel, ("c",))[3]
    assert r["base_rss"] == pytest.approx(base @ base)


def test_two_way(frame, panel):
    r = regression.two_way_table(frame, ["m"], "k", "u", ["x", "c"], "y").first()
    x, inverse, _, e = dummy_fit(panel)
    both = (panel["k"] + panel["u"]).to_numpy()
    v = sum(s * cluster_cov(x, inverse, e, c) for s, c in ((1, panel["k"].to_numpy()), (1, panel["u"].to_numpy()), (-1, both)))
    assert r["standard_error"] == pytest.approx(math.sqrt(max(v[0, 0], 0)))


def test_single_keyword_uses_hc3(spark, panel):
    p = panel[panel["k"] == "k0"]
    r = regression.regression_table(spark.createDataFrame(p.assign(m=1)), ["m"], "k", ["x", "c"], "y").first()
    x, inverse, b, e = dummy_fit(p)
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    v = inverse @ (x * (e / (1 - h))[:, None] ** 2).T @ x @ inverse
    assert r["covariance"] == "HC3"
    assert r["standard_errors"] == pytest.approx(np.sqrt(np.diag(inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse))[:2])
    del v


def test_influence(frame, panel):
    rows = diagnostics.influence_rows(frame, ["m"], "k", ["x", "c"], "y").toPandas()
    p = panel.sort_values(["k", "serp_rank"]).reset_index(drop=True)
    rows = rows.sort_values(["k", "serp_rank"]).reset_index(drop=True)
    x, inverse, b, e = dummy_fit(p)
    n, k = x.shape
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    s2 = e @ e / (n - k)
    s2i = (e @ e - e**2 / (1 - h)) / (n - k - 1)
    t = e / np.sqrt(s2i * (1 - h))
    assert np.allclose(rows["leverage"], h)
    assert np.allclose(rows["cooks_d"], e**2 / (s2 * (1 - h)) * h / (1 - h) / k)
    assert np.allclose(rows["studentized_residual"], t)
    assert np.allclose(rows["dffits"], t * np.sqrt(h / (1 - h)))
    step = (inverse @ x.T).T * (e / (1 - h))[:, None] / np.sqrt(s2i[:, None] * np.diag(inverse))
    assert np.allclose(rows["dfbeta_x"], step[:, 0]) and np.allclose(rows["dfbeta_c"], step[:, 1])


def test_specification(frame, panel):
    r = diagnostics.specification_tests(frame, ["m"], "k", ["x", "c"], "y").first()
    x, inverse, b, e = dummy_fit(panel)
    n, k = x.shape
    fitted = panel["y"] - e
    wider = np.column_stack([x, fitted**2])
    rss2 = np.linalg.lstsq(wider, panel["y"], rcond=None)[1][0]
    f = (e @ e - rss2) / (rss2 / (n - k - 1))
    u = e**2 - (e**2).mean()
    bp = 1 - np.linalg.lstsq(x, e**2, rcond=None)[1][0] / (u @ u)
    assert r["reset_f"] == pytest.approx(f, rel=1e-6)
    assert r["bp_lm"] == pytest.approx(n * bp)
    assert r["bp_f"] == pytest.approx((bp / (k - 1)) / ((1 - bp) / (n - k)))
    assert r["reset_p_value"] == pytest.approx(float(dist.f_upper(f, 1.0, n - k - 1.0)))
    a, b2 = pd.Series(e).rank(), pd.Series(np.asarray(fitted)).rank()
    assert r["spearman_r"] == pytest.approx(a.corr(b2))


def test_vif_and_drop_order(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=200) + 3
    p = pd.DataFrame({"k": np.arange(200) % 8, "a": base, "b": base + rng.normal(size=200) * 0.05, "z": rng.normal(size=200), "y": rng.normal(size=200), "m": 1})
    frame = spark.createDataFrame(p)
    g = p[["a", "b", "z"]].to_numpy()
    want = [1 / (1 - np.linalg.lstsq(np.delete(g, j, 1), g[:, j], rcond=None)[0] @ np.delete(g, j, 1).T @ g[:, j] / (g[:, j] @ g[:, j])) for j in range(3)]
    got = {r["term"]: r["vif"] for r in diagnostics.variance_inflation(frame, ["m"], ["a", "b", "z"]).collect()}
    assert [got[c] for c in "abz"] == pytest.approx(want, rel=1e-6)
    steps = diagnostics.joint_model(frame, ["m"], "k", ["a", "b"], ["z"], ["b", "a"], "y").collect()
    final = {r["term"] for r in steps if r["final"]}
    assert final == {"a", "z"} and {r["dropped_before"] for r in steps if r["final"]} == {"b"}
    stuck = diagnostics.joint_model(frame, ["m"], "k", ["a"], ["b"], ["a"], "y").collect()
    assert {r["status"] for r in stuck} == {"unresolved"}


def brute_logit(lists, b):
    """Log-likelihood, gradient and Hessian by direct loops."""
    ll, g, h = 0.0, np.zeros(len(b)), np.zeros((len(b), len(b)))
    scores = []
    for x in lists:
        own = np.zeros(len(b))
        for i in range(len(x)):
            u = x[i:] @ b
            w = np.exp(u - u.max())
            w /= w.sum()
            m = w @ x[i:]
            ll += math.log(w[0])
            own += x[i] - m
            h -= (x[i:].T * w) @ x[i:] - np.outer(m, m)
        scores.append(own)
        g += own
    return ll, g, h, np.array(scores)


def test_ranked_logit(spark, panel):
    p = panel.assign(m="m")
    out = ranked_logit.ranked_logit(spark.createDataFrame(p), ["m"], "k", "x", ["c"]).first()
    lists = [np.column_stack([np.sign(g["x"]) * np.log1p(g["x"].abs()), g["c"]]) for _, g in p.sort_values("serp_rank").groupby("k")]
    b = np.zeros(2)
    for _ in range(50):
        _, g, h, s = brute_logit(lists, b)
        b = b - np.linalg.solve(h, g)
    ll, g, h, s = brute_logit(lists, b)
    inverse = np.linalg.inv(-h)
    se = math.sqrt((inverse @ s.T @ s @ inverse)[0, 0])
    assert out["converged"] and out["coefficient"] == pytest.approx(b[0], rel=1e-6)
    assert out["log_likelihood"] == pytest.approx(ll)
    assert out["standard_error"] == pytest.approx(se, rel=1e-5)
    sd = math.sqrt(np.mean([np.var(x[:, 0], ddof=1) for x in lists]))
    assert out["odds_ratio_per_sd"] == pytest.approx(math.exp(b[0] * sd), rel=1e-6)
    assert out["drift"] is not None


def test_ranked_logit_leaves_out_repeated_ranks(spark):
    rows = [("m", "a", 1, 1.0), ("m", "a", 1, 2.0), ("m", "b", 1, 2.0), ("m", "b", 2, 1.0), ("m", "b", 3, 1.5), ("m", "c", 1, 1.0)]
    frame = spark.createDataFrame(rows, "m string, k string, serp_rank int, x double")
    assert {r["k"] for r in ranked_logit.prepare_lists(frame, ["m"], "k", "x").collect()} == {"b"}


def test_perfect_and_constant_correlations(spark):
    rows = [("a", i, 4.0 * -math.log(i)) for i in range(1, 21)] + [("b", i, 2.0) for i in range(1, 4)] + [("c", 1, 1.0)]
    frame = spark.createDataFrame(rows, "k string, serp_rank int, x double")
    for bounded in (True, False):
        got = {r["k"]: (r["rho"], r["p_value"]) for r in spearman.keyword_correlations(frame, ["k"], "x", bounded=bounded).collect()}
        assert got == {"a": (-1.0, 0.0), "b": (0.0, 1.0)}


def test_golden_panel(spark):
    rows = [(f"k{k}", r, 4.0 * -math.log(r) + 0.01 * k, 0.1 * k + 0.01 * r, ((5 * k + 13 * r) % 11) * 0.01) for k in range(12) for r in range(1, 21)]
    frame = spark.createDataFrame(rows, "target_keyword_id string, serp_rank int, score double, site_scale double, authority_proxy double")
    out = bundle.association_table(frame, ["score"], ["site_scale", "authority_proxy"]).collect()
    assert len(out) == 4
    for r in out:
        assert r["median_rho"] == -1.0 and r["mode"] == "confirmatory" and r["actionable"]
        assert r["coefficient"] == pytest.approx(0.25)
    flat = frame.withColumn("serp_rank", F.lit(1))
    assert {r["mode"] for r in bundle.association_table(flat, ["score"], ["site_scale", "authority_proxy"]).collect()} == {"hard_fail"}


def test_entity_panel(spark):
    rows = [("e", f"k{k}", f"kw{k:02d}", f"h{r}", f"u{r}", r, int(r <= 5), int(r <= 5), 0.5 if r <= 5 else None, 0.1 * r if r <= 5 else None, ["M"] if r <= 5 else [], ["T"]) for k in range(10) for r in range(1, 21)]
    frame = spark.createDataFrame(rows, "entity_id string, target_keyword_id string, target_keyword string, canonical_url_hash string, url string, serp_rank int, entity_present int, entity_mention_count int, entity_confidence_mean double, entity_relevance_mean double, matched_texts array<string>, entity_types array<string>")
    got = {r["metric"]: r for r in entities.entity_associations(frame).collect()}
    assert got["entity_present"]["status"] == "significant" and got["entity_present"]["median_spearman_rho"] < 0
    assert got["entity_confidence_mean"]["status"] == "non-estimable"
    assert entities.entity_examples(frame).first()["example_urls"] == ["u1"] * 3


def test_tails():
    assert dist.student_t_two_sided([2.570582, 12.7062], [5, 1]) == pytest.approx([0.05, 0.05], abs=1e-6)
    assert dist.f_upper([4.102821], [2], [10]) == pytest.approx([0.05], abs=1e-6)
    assert dist.chi2_upper([3.841459, 18.307], [1, 10]) == pytest.approx([0.05, 0.05], abs=1e-5)
    assert dist.student_t_quantile([0.975, 0.025], [10, 10]) == pytest.approx([2.228139, -2.228139], abs=1e-6)
    assert dist.normal_two_sided([1.959964]) == pytest.approx([0.05], abs=1e-6)


def test_entity_signals(spark):
    ents = spark.createDataFrame([("r", "k", "kw", "ha", "a", "entity-a", "Alpha", 2.0, 0.2, ["Topic"]), ("r", "k", "kw", "ha", "a", "entity-a", "A", 4.0, 0.6, ["Concept", None])],
        "run_id string, target_keyword_id string, target_keyword string, canonical_url_hash string, url string, entity_id string, matched_text string, confidence double, relevance double, types array<string>")
    pages = spark.createDataFrame([("r", "k", "kw", "ha", "a"), ("r", "k", "kw", "hb", "b")], "run_id string, target_keyword_id string, target_keyword string, canonical_url_hash string, url string")
    serp = spark.createDataFrame([("r", "k", "ha", 4), ("r", "k", "ha", 2), ("r", "k", "hb", 1)], "run_id string, target_keyword_id string, canonical_url_hash string, serp_rank bigint")
    a, b = entity_signals(ents, pages, serp).orderBy("url").collect()
    assert (a["entity_present"], a["entity_mention_count"], a["serp_rank"], a["entity_confidence_mean"]) == (1, 2, 2, 3.0)
    assert (a["matched_texts"], a["entity_types"]) == (["A", "Alpha"], ["Concept", "Topic"])
    assert (b["entity_present"], b["entity_mention_count"], b["entity_confidence_mean"], b["matched_texts"], b["entity_types"]) == (0, 0, None, [], [])


def test_domain_scores(spark):
    rows = [("r", f"d{i}", f"h{p}", float(i * 10 + p), float(i)) for i in range(4) for p in range(2)]
    frame = spark.createDataFrame(rows, "run_id string, domain string, canonical_url_hash string, a double, b double")
    got = {r["domain"]: r["site_scale"] for r in site_scale(frame, ["a", "b"]).collect()}
    med = np.log1p(np.array([[i * 10 + 0.5, i] for i in range(4)]))
    want = ((med - med.mean(0)) / med.std(0, ddof=1)).mean(1)
    assert [got[f"d{i}"] for i in range(4)] == pytest.approx(want)
    holes = frame.withColumn("b", F.expr("if(domain = 'd1', NULL, b)"))
    assert {r["domain"]: r["site_scale"] for r in site_scale(holes, ["a", "b"]).collect()}["d1"] is None
    flat = frame.withColumns({"bad": F.lit(True), "t": F.lit(3.0)})
    assert {r["authority_proxy"] for r in authority_proxy(flat, ["t"], [], ["bad"]).collect()} == {0.0}
    worse = frame.withColumn("bad", F.col("domain") == "d2")
    scores = {r["domain"]: r["authority_proxy"] for r in authority_proxy(worse, [], [], ["bad"]).collect()}
    assert scores["d2"] == min(scores.values())


def test_mentions_give_the_same_associations(spark):
    """With and without absence rows, on random pages with ties and full presence."""
    rng = np.random.default_rng(5)
    pages = [(f"k{k}", f"h{p}", f"u{p}", int(rng.integers(1, 8))) for k in range(6) for p in range(9)]
    signals, seen = [], []
    for e in range(4):
        for k, h, u, r in pages:
            n = int(rng.integers(0, 4)) if e else 1
            mean = float(rng.integers(0, 5)) if n else None
            signals.append((f"e{e}", k, k, h, u, r, int(n > 0), n, mean, mean))
            if n:
                seen.append((f"e{e}", k, h, n, mean, mean))
    full = spark.createDataFrame(signals, "entity_id string, target_keyword_id string, target_keyword string, canonical_url_hash string, url string, serp_rank int, entity_present int, entity_mention_count int, entity_confidence_mean double, entity_relevance_mean double")
    part = spark.createDataFrame(seen, "entity_id string, target_keyword_id string, canonical_url_hash string, entity_mention_count int, entity_confidence_mean double, entity_relevance_mean double")
    ranked = spark.createDataFrame(pages, "target_keyword_id string, canonical_url_hash string, url string, serp_rank int")
    a = entities.entity_associations(full, min_tested=2).toPandas().set_index(["entity_id", "metric"]).sort_index()
    b = entities.mention_associations(part, ranked, min_tested=2).toPandas().set_index(["entity_id", "metric"]).sort_index()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-12)
