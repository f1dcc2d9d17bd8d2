"""Queries for rank correlation, group-effect regression, diagnostics and ranked choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.dist import chi2_tail, f_tail, t_two_sided
from rankloom.functions.numeric import rank_outcome
from rankloom.operators.filters import RANK_DEPTHS, expand_depths
from rankloom.operators.marts import best_ranks, entity_occurrences
from rankloom.operators.marts import entity_signals as build_entity_signals
from rankloom.plans import standins as st
from rankloom.plans.marts import _ENTITY, _entity_inputs
from rankloom.plans.standins import table
from rankloom.session import cut_lineage
from rankloom.stats import bundle, diagnostics, entities, ranked_logit, regression, spearman
from rankloom.stats.moments import element, melt_signals

SIGNALS = ("l_discount", "l_tax", "l_quantity")
CONTROLS = ("c1", "c2")
_DEPTH_ROWS = "(VALUES ('top_20', 20), ('top_10', 10), ('top_5', 5), ('top_3', 3)) t(rank_depth, max_rank)"


def _long(spark, d, stored=False):
    """The panel at all depths, one row per signal.  The rows of a list are brought together before they multiply.

    ``stored`` writes the panel once, for queries that read the rows more than once.
    """
    panel = st.panel(spark, d)
    if stored:
        panel = cut_lineage(panel.select("keyword_id", "url_id", "serp_rank", "l_extendedprice", *SIGNALS))
    panel = panel.repartition("keyword_id").withColumns({"outcome": rank_outcome(F.col("serp_rank")), "c1": F.ln("l_extendedprice"), "c2": (F.col("url_id") % 13).cast("double")})
    return melt_signals(expand_depths(panel), SIGNALS, ["rank_depth", "keyword_id", "url_id", "serp_rank", "outcome", *CONTROLS])


_LONG = f"""{st.PANEL}, long AS (
  SELECT rank_depth, keyword_id, url_id, serp_rank, -ln(serp_rank) AS outcome, ln(l_extendedprice) AS c1, (url_id % 13)::DOUBLE AS c2, signal, value
  FROM panel JOIN {_DEPTH_ROWS} ON serp_rank <= max_rank, LATERAL (VALUES ('l_discount', l_discount), ('l_tax', l_tax), ('l_quantity', l_quantity)) s(signal, value))"""

MODEL = ["rank_depth", "signal"]

_RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY rank_depth, signal, keyword_id ORDER BY value)
    + (count(*) OVER (PARTITION BY rank_depth, signal, keyword_id, value) - 1) / 2.0 AS a FROM long),
tests AS (SELECT rank_depth, signal, keyword_id, count(*) AS n_rows,
  CASE WHEN min(a) = max(a) OR min(serp_rank) = max(serp_rank) OR abs(corr(a, serp_rank)) < 1e-12 THEN 0 ELSE corr(a, serp_rank) END AS rho FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def _tests(spark, d):
    """A rank correlation per depth, signal and list."""
    return spearman.list_correlations(st.panel(spark, d), ["keyword_id"], SIGNALS, dict(RANK_DEPTHS))


def correlations(spark, d):
    return _tests(spark, d).select(*MODEL, "keyword_id", "n_rows", F.round(F.col("rho") + 0.0, 6).alias("rho"))


CORRELATIONS = f"WITH {_LONG}, {_RANKED} SELECT rank_depth, signal, keyword_id, n_rows, round(rho + 0.0, 6) AS rho FROM tests"


def correlations_whole(spark, d):
    """Uncut lists: every line item of a supplier, ranked by price."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    tests = spearman.keyword_correlations(rows, ["l_suppkey"], "l_quantity", "l_extendedprice", bounded=False)
    return tests.select("l_suppkey", "n_rows", F.round("rho", 6).alias("rho"))


CORRELATIONS_WHOLE = """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT l_suppkey, count(*) AS n_rows, round(corr(a, b), 6) AS rho FROM r GROUP BY 1"""


def correlation_summary(spark, d):
    out = spearman.summarize_correlations(cut_lineage(_tests(spark, d).select(*MODEL, "rho")), MODEL)
    return out.select(*MODEL, "keyword_count", *[F.round(F.col(c) + 0.0, 5).alias(c) for c in ("median_rho", "rho_iqr", "fraction_same_sign")], "status", spearman.inference_mode(F.col("keyword_count")).alias("mode"))


CORRELATION_SUMMARY = f"""WITH {_LONG}, {_RANKED}, m AS (SELECT rank_depth, signal, median(rho) AS m, quantile_cont(rho, 0.75) - quantile_cont(rho, 0.25) AS iqr, count(*) AS k FROM tests GROUP BY 1, 2)
SELECT rank_depth, signal, max(k) AS keyword_count, round(max(m) + 0.0, 5) AS median_rho, round(max(iqr) + 0.0, 5) AS rho_iqr,
  round(avg((sign(rho) = sign(m))::INT) + 0.0, 5) AS fraction_same_sign, CASE WHEN max(k) >= 10 THEN 'computed' ELSE 'skipped' END AS status,
  CASE WHEN max(k) = 1 THEN 'underpowered' WHEN max(k) < 10 THEN 'exploratory' ELSE 'confirmatory' END AS mode
FROM tests JOIN m USING (rank_depth, signal) GROUP BY 1, 2"""


def false_discovery(spark, d):
    """q-values of given p-values: order totals as tests, priorities as families."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "round(o_totalprice / 600000, 4) AS p_value")
    out = spearman.adjust_p_values(rows, ["o_orderpriority"])
    return out.select("o_orderkey", "o_orderpriority", "p_value", F.round("bh_q_value", 6).alias("bh_q_value"))


FALSE_DISCOVERY = """WITH p AS (SELECT o_orderkey, o_orderpriority, round(o_totalprice / 600000, 4) AS p_value FROM orders),
r AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS m, count(*) OVER (PARTITION BY o_orderpriority ORDER BY p_value) AS k FROM p)
SELECT o_orderkey, o_orderpriority, p_value, round(min(least(1, p_value * m / k)) OVER (PARTITION BY o_orderpriority ORDER BY p_value DESC), 6) AS bh_q_value FROM r"""


def adjusted_correlations(spark, d):
    out = spearman.adjusted_tests(cut_lineage(_tests(spark, d).select(*MODEL, "keyword_id", "p_value")), MODEL)
    return out.select(*MODEL, "keyword_id", F.round("p_value", 6).alias("p_value"), F.round("bh_q_value", 6).alias("bh_q_value"))


def slopes(spark, d):
    """One regressor with supplier effects over all line items, for three signals."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.ln("l_extendedprice").alias("outcome"), *SIGNALS)
    out = regression.slope_table(melt_signals(rows, SIGNALS, ["l_suppkey", "outcome"]), ["signal"], "l_suppkey", "value")
    return out.select("signal", "n", "groups", *[F.round(F.col(c), 6).alias(c) for c in ("coefficient", "standard_error", "within_r_squared")])


SLOPES = """WITH l AS (SELECT l_suppkey AS g, ln(l_extendedprice) AS y, signal, value FROM lineitem, LATERAL (VALUES ('l_discount', l_discount), ('l_tax', l_tax), ('l_quantity', l_quantity)) s(signal, value)),
c AS (SELECT signal, g, value - avg(value) OVER w AS x, y - avg(y) OVER w AS y FROM l WINDOW w AS (PARTITION BY signal, g)),
b AS (SELECT signal, count(*) AS n, count(DISTINCT g) AS groups, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, regr_r2(y, x) AS r2 FROM c GROUP BY 1),
u AS (SELECT signal, g, sum(x * (y - b * x)) AS u FROM c JOIN b USING (signal) GROUP BY 1, 2),
m AS (SELECT signal, sum(u * u) AS meat FROM u GROUP BY 1)
SELECT signal, n, groups, round(b, 6) AS coefficient,
  round(sqrt(meat * (groups / (groups - 1)) * ((n - 1) / (n - groups - 1))) / sxx, 6) AS standard_error, round(r2, 6) AS within_r_squared
FROM b JOIN m USING (signal)"""


def regressions(spark, d):
    """All (depth, signal) models with two controls in one job."""
    out = regression.regression_table(_long(spark, d), MODEL, "keyword_id", ["value", *CONTROLS])
    return out.select(*MODEL, "n", "groups", "status", *[F.round(element(F.col("beta"), i), 5).alias(f"b{i}") for i in range(3)],
                      F.round("r_squared", 5).alias("r_squared"), F.round("adjusted_r_squared", 5).alias("adjusted_r_squared"),
                      F.round("base_r_squared", 5).alias("base_r_squared"), F.round("aic", 3).alias("aic"))


_DET = "(sxx * s11 * s22 + 2 * sx1 * s12 * sx2 - sxx * s12 * s12 - s11 * sx2 * sx2 - s22 * sx1 * sx1)"
REGRESSIONS = f"""WITH {_LONG}, c AS (SELECT rank_depth, signal, keyword_id, outcome, value - avg(value) OVER w AS x, c1 - avg(c1) OVER w AS a, c2 - avg(c2) OVER w AS b,
  outcome - avg(outcome) OVER w AS y FROM long WINDOW w AS (PARTITION BY rank_depth, signal, keyword_id)),
s AS (SELECT rank_depth, signal, count(*) AS n, count(DISTINCT keyword_id) AS groups, sum(x*x) AS sxx, sum(x*a) AS sx1, sum(x*b) AS sx2, sum(a*a) AS s11, sum(a*b) AS s12, sum(b*b) AS s22,
  sum(x*y) AS sxy, sum(a*y) AS s1y, sum(b*y) AS s2y, sum(y*y) AS syy, count(*) * var_pop(outcome) AS tss FROM c GROUP BY 1, 2),
i AS (SELECT *, (sxy * (s11*s22 - s12*s12) - s1y * (sx1*s22 - sx2*s12) + s2y * (sx1*s12 - sx2*s11)) / {_DET} AS b0,
  (-sxy * (sx1*s22 - sx2*s12) + s1y * (sxx*s22 - sx2*sx2) - s2y * (sxx*s12 - sx1*sx2)) / {_DET} AS b1,
  (sxy * (sx1*s12 - sx2*s11) - s1y * (sxx*s12 - sx1*sx2) + s2y * (sxx*s11 - sx1*sx1)) / {_DET} AS b2,
  (s1y * (s22*s1y - s12*s2y) + s2y * (s11*s2y - s12*s1y)) / (s11*s22 - s12*s12) AS base FROM s),
f AS (SELECT *, syy - b0*sxy - b1*s1y - b2*s2y AS rss, n - groups - 3 AS df FROM i)
SELECT rank_depth, signal, n, groups, 'computed' AS status, round(b0, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(1 - rss/tss, 5) AS r_squared,
  round(1 - (rss/tss) * (n - 1) / df, 5) AS adjusted_r_squared, round(1 - (syy - base)/tss, 5) AS base_r_squared,
  round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * (groups + 3), 3) AS aic FROM f"""


def clustered_inference(spark, d):
    out = regression.regression_table(_long(spark, d), MODEL, "keyword_id", ["value", *CONTROLS])
    return out.select(*MODEL, "covariance", "inference_df", *[F.round(element(F.col(c), 0), 6).alias(c) for c in ("standard_errors", "p_values", "ci_low", "ci_high")])


def single_list_inference(spark, d):
    """One model per supplier: no clusters, so HC3."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.lit(1).alias("g"), F.col("l_quantity").alias("value"), F.ln("l_extendedprice").alias("outcome"))
    out = regression.regression_table(rows, ["l_suppkey"], "g", ["value"])
    return out.select("l_suppkey", "covariance", F.round(element(F.col("beta"), 0), 6).alias("coefficient"), F.round(element(F.col("standard_errors"), 0), 6).alias("standard_error"))


SINGLE_LIST_INFERENCE = """WITH c AS (SELECT l_suppkey, count(*) OVER w AS n, l_quantity - avg(l_quantity) OVER w AS x, ln(l_extendedprice) - avg(ln(l_extendedprice)) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
b AS (SELECT l_suppkey, sum(x*y) / sum(x*x) AS b, sum(x*x) AS sxx FROM c GROUP BY 1)
SELECT l_suppkey, 'HC3' AS covariance, round(any_value(b), 6) AS coefficient, round(sqrt(sum(x*x * pow((y - b*x) / (1 - 1/n - x*x/sxx), 2))) / any_value(sxx), 6) AS standard_error
FROM c JOIN b USING (l_suppkey) GROUP BY 1"""


def two_way(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.ln("l_extendedprice").alias("outcome"), *SIGNALS)
    long = melt_signals(rows, SIGNALS, ["l_suppkey", "l_partkey", "outcome"])
    out = regression.two_way_table(long, ["signal"], "l_suppkey", "l_partkey", ["value"])
    return out.select("signal", "status", F.round("coefficient", 6).alias("coefficient"), F.round("standard_error", 6).alias("standard_error"), "inference_df")


TWO_WAY = """WITH l AS (SELECT l_suppkey AS g, l_partkey AS p, ln(l_extendedprice) AS y, signal, value FROM lineitem, LATERAL (VALUES ('l_discount', l_discount), ('l_tax', l_tax), ('l_quantity', l_quantity)) s(signal, value)),
c AS (SELECT signal, g, p, value - avg(value) OVER w AS x, y - avg(y) OVER w AS y FROM l WINDOW w AS (PARTITION BY signal, g)),
b AS (SELECT signal, count(*) AS n, count(DISTINCT g) AS k, sum(x*y)/sum(x*x) AS b, sum(x*x) AS sxx FROM c GROUP BY 1),
e AS (SELECT signal, g, p, x * (y - b*x) AS s, n, k, b, sxx FROM c JOIN b USING (signal)),
v1 AS (SELECT signal, sum(u*u) * (count(*)/(count(*)-1)) AS v, count(*) AS m FROM (SELECT signal, g, sum(s) AS u FROM e GROUP BY 1, 2) GROUP BY 1),
v2 AS (SELECT signal, sum(u*u) * (count(*)/(count(*)-1)) AS v, count(*) AS m FROM (SELECT signal, p, sum(s) AS u FROM e GROUP BY 1, 2) GROUP BY 1),
v3 AS (SELECT signal, sum(u*u) * (count(*)/(count(*)-1)) AS v FROM (SELECT signal, g, p, sum(s) AS u FROM e GROUP BY 1, 2, 3) GROUP BY 1)
SELECT signal, 'computed' AS status, round(b, 6) AS coefficient, round(sqrt(greatest((v1.v + v2.v - v3.v) * ((n-1)/(n-k-1)), 0)) / sxx, 6) AS standard_error, least(v1.m, v2.m) - 1 AS inference_df
FROM b JOIN v1 USING (signal) JOIN v2 USING (signal) JOIN v3 USING (signal)"""


def effect_sizes(spark, d):
    long = _long(spark, d)
    fits = regression.fit_models(long, MODEL, "keyword_id", ["value"])[1]
    out = regression.effect_size(fits, long, MODEL, "keyword_id", "value")
    return out.select(*MODEL, F.round("signal_sd", 6).alias("signal_sd"), "median_rank", F.round("rank_change_per_sd", 5).alias("rank_change_per_sd"))


EFFECT_SIZES = f"""WITH {_LONG}, k AS (SELECT rank_depth, signal, keyword_id, var_samp(value) AS v, (count(*)) * covar_pop(value, outcome) AS sxy, count(*) * var_pop(value) AS sxx FROM long GROUP BY 1, 2, 3),
m AS (SELECT rank_depth, signal, sqrt(avg(v)) AS sd, sum(sxy) / sum(sxx) AS b FROM k GROUP BY 1, 2), r AS (SELECT rank_depth, signal, median(serp_rank) AS mr FROM long GROUP BY 1, 2)
SELECT rank_depth, signal, round(sd, 6) AS signal_sd, mr AS median_rank, round(mr * (exp(-(b * sd)) - 1), 5) AS rank_change_per_sd FROM m JOIN r USING (rank_depth, signal)"""


def model_status(spark, d):
    """Status of tiny and degenerate models: one model per customer over the orders."""
    rows = table(spark, d, "orders").selectExpr("o_custkey", "o_orderstatus AS g", "if(o_custkey % 5 = 0, 1.0, o_totalprice) AS value", "ln(o_orderkey + 1) AS outcome")
    fits = regression.fit_models(rows, ["o_custkey"], "g", ["value"])[1]
    return fits.select("o_custkey", "n", "groups", "status", "reason")


MODEL_STATUS = """WITH o AS (SELECT o_custkey, o_orderstatus AS g, CASE WHEN o_custkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS x FROM orders),
k AS (SELECT o_custkey, g, count(*) AS n, max(x) > min(x) AS varies FROM o GROUP BY 1, 2), m AS (SELECT o_custkey, sum(n)::BIGINT AS n, count(*) AS groups, bool_or(varies) AS varies FROM k GROUP BY 1)
SELECT o_custkey, n, groups, CASE WHEN n >= 3 AND varies AND n > groups + 1 THEN 'computed' ELSE 'skipped' END AS status,
  CASE WHEN n < 3 THEN 'insufficient_rows' WHEN NOT varies THEN 'parameter_not_estimable' WHEN n <= groups + 1 THEN 'insufficient_design' END AS reason FROM m"""


# --- diagnostics ------------------------------------------------------------


def influence(spark, d):
    """Row influence of the supplier-effect model over all line items."""
    rows = table(spark, d, "lineitem").select(F.lit("m").alias("model"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value"), F.ln("l_extendedprice").alias("outcome"))
    out = diagnostics.influence_rows(rows, ["model"], "l_suppkey", ["value"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 6).alias(c) for c in ("leverage", "cooks_d", "studentized_residual", "dffits", "max_abs_dfbeta")], "cooks_flag", "studentized_flag")


_INFLUENCE = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER w AS nk, l_quantity, ln(l_extendedprice) AS yy,
  l_quantity - avg(l_quantity) OVER w AS x, ln(l_extendedprice) - avg(ln(l_extendedprice)) OVER w AS y
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
b AS (SELECT count(*) AS n, count(DISTINCT l_suppkey) + 1 AS k, sum(x*y)/sum(x*x) AS b, sum(x*x) AS sxx, sum(y*y) - sum(x*y)*sum(x*y)/sum(x*x) AS rss FROM c),
r AS (SELECT *, y - b*x AS e, 1/nk + x*x/sxx AS h FROM c, b),
q AS (SELECT *, (rss - e*e/(1-h)) / (n-k-1) AS s2i FROM r),
t AS (SELECT *, e / sqrt(s2i*(1-h)) AS ext FROM q),
z AS (SELECT *, e*e/((rss/(n-k))*(1-h)) * h/((1-h)*k) AS cd FROM t)"""
INFLUENCE = f"""WITH {_INFLUENCE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(h, 6) AS leverage, round(cd, 6) AS cooks_d, round(ext, 6) AS studentized_residual,
  round(ext * sqrt(h/(1-h)), 6) AS dffits, round(abs(x/sxx * e/(1-h) / sqrt(s2i/sxx)), 6) AS max_abs_dfbeta, cd > 4.0/n AS cooks_flag, abs(ext) > 3 AS studentized_flag FROM z"""


def influence_counts(spark, d):
    out = diagnostics.influence_summary(diagnostics.influence_rows(_long(spark, d, stored=True), MODEL, "keyword_id", ["value", *CONTROLS]), MODEL)
    return out.withColumn("influential_rate", F.round("influential_rate", 6))


def influence_refit(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("m").alias("model"), "l_suppkey", F.col("l_quantity").alias("value"), F.ln("l_extendedprice").alias("outcome"))
    out = diagnostics.influence_refit(rows, ["model"], "l_suppkey", ["value"])
    return out.select("row_count", "influential_row_count", "trimmed_row_count", *[F.round(c, 6).alias(c) for c in ("confirmatory_coefficient", "sensitivity_coefficient", "coefficient_delta")])


INFLUENCE_REFIT = f"""WITH {_INFLUENCE}, kept AS (SELECT l_suppkey, l_quantity, yy AS y FROM z WHERE cd <= 4.0/n),
c2 AS (SELECT l_quantity - avg(l_quantity) OVER w AS x, y - avg(y) OVER w AS y FROM kept WINDOW w AS (PARTITION BY l_suppkey)), b2 AS (SELECT sum(x*y)/sum(x*x) AS b2, count(*) AS n2 FROM c2)
SELECT n AS row_count, n - n2 AS influential_row_count, n2 AS trimmed_row_count, round(b, 6) AS confirmatory_coefficient, round(b2, 6) AS sensitivity_coefficient, round(b2 - b, 6) AS coefficient_delta FROM b, b2"""


def specification(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("m").alias("model"), "l_suppkey", F.col("l_quantity").alias("value"), F.ln("l_extendedprice").alias("outcome"))
    out = diagnostics.specification_tests(rows, ["model"], "l_suppkey", ["value"])
    return out.select("n", "groups", "reset_status", F.round("bp_lm", 4).alias("bp_lm"), F.round("bp_f", 4).alias("bp_f"), F.round("residual_sd", 6).alias("residual_sd"), F.round("fitted_sd", 6).alias("fitted_sd"), F.round("spearman_r", 4).alias("spearman_r"), F.round("reset_f", 3).alias("reset_f"))


SPECIFICATION = """WITH c AS (SELECT l_suppkey AS g, l_quantity - avg(l_quantity) OVER w AS x, ln(l_extendedprice) AS yy, ln(l_extendedprice) - avg(ln(l_extendedprice)) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
b AS (SELECT count(*) AS n, count(DISTINCT g) AS k, sum(x*y)/sum(x*x) AS b, sum(y*y) - sum(x*y)*sum(x*y)/sum(x*x) AS rss FROM c),
r AS (SELECT g, x, y, y - b*x AS e, yy - (y - b*x) AS f, pow(y - b*x, 2) AS e2, n, k, rss FROM c, b),
w AS (SELECT *, e2 - avg(e2) OVER p AS ec, f*f - avg(f*f) OVER p AS fc, rank() OVER (ORDER BY e) AS re, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf FROM r WINDOW p AS (PARTITION BY g)),
s AS (SELECT any_value(n) AS n, any_value(k) AS k, any_value(rss) AS rss, sum(ec*ec) - pow(sum(x*ec), 2)/sum(x*x) AS rss2, n * var_pop(e2) AS tss2, stddev_samp(e) AS rs, stddev_samp(f) AS fs, corr(re, rf) AS sp,
  sum(x*x) AS sxx, sum(x*fc) AS sxf, sum(fc*fc) AS sff, sum(x*y) AS sxy, sum(fc*y) AS sfy, sum(y*y) AS syy FROM w GROUP BY n),
t AS (SELECT *, 1 - rss2/tss2 AS r2, syy - (sxy*(sff*sxy - sxf*sfy) + sfy*(sxx*sfy - sxf*sxy))/(sxx*sff - sxf*sxf) AS rssw FROM s)
SELECT n, k AS groups, 'computed' AS reset_status, round(n*r2, 4) AS bp_lm, round((r2/k)/((1-r2)/(n-k-1)), 4) AS bp_f, round(rs, 6) AS residual_sd, round(fs, 6) AS fitted_sd, round(sp, 4) AS spearman_r,
  round((rss - rssw)/(rssw/(n-k-2)), 3) AS reset_f FROM t"""


def inflation(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", *SIGNALS)
    out = diagnostics.variance_inflation(rows, ["l_returnflag"], list(SIGNALS))
    return out.withColumn("vif", F.round("vif", 6))


_VIF_DET = "(a*d*f + 2*b*c*e - a*e*e - d*c*c - f*b*b)"
INFLATION = f"""WITH g AS (SELECT l_returnflag, sum(l_discount*l_discount) AS a, sum(l_discount*l_tax) AS b, sum(l_discount*l_quantity) AS c, sum(l_tax*l_tax) AS d, sum(l_tax*l_quantity) AS e, sum(l_quantity*l_quantity) AS f FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'l_discount' AS term, round(a*(d*f - e*e)/{_VIF_DET}, 6) AS vif FROM g UNION ALL SELECT l_returnflag, 'l_tax', round(d*(a*f - c*c)/{_VIF_DET}, 6) FROM g
UNION ALL SELECT l_returnflag, 'l_quantity', round(f*(a*d - b*b)/{_VIF_DET}, 6) FROM g"""


def joint_model(spark, d):
    """Scores dropped one by one until no inflation factor exceeds 2.2."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("m"), "l_suppkey", *SIGNALS, F.ln("l_extendedprice").alias("outcome"), F.lit(1.0).alias("c"))
    out = diagnostics.joint_model(rows, ["m"], "l_suppkey", list(SIGNALS), [], ["l_tax", "l_quantity", "l_discount"], max_vif=2.2)
    return out.select("m", "n", "step", "term", F.round("coefficient", 5).alias("coefficient"), F.round("vif", 5).alias("vif"), "dropped_before", "status", "final")


def explainability(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", *SIGNALS, F.ln("l_extendedprice").alias("outcome"))
    out = diagnostics.explainability(rows, "l_suppkey", {"rates": ["l_discount", "l_tax"], "all": list(SIGNALS)})
    return out.withColumns({c: F.round(c, 6) for c in ("r_squared", "adjusted_r_squared", "adjusted_r_squared_delta")}).select("kind", "name", "n", "status", "r_squared", "adjusted_r_squared")


EXPLAINABILITY = """WITH c AS (SELECT l_suppkey AS g, ln(l_extendedprice) AS yy, ln(l_extendedprice) - avg(ln(l_extendedprice)) OVER w AS y, l_discount - avg(l_discount) OVER w AS a, l_tax - avg(l_tax) OVER w AS b, l_quantity - avg(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
s AS (SELECT count(*) AS n, count(DISTINCT g) AS k, n * var_pop(yy) AS tss, sum(y*y) AS syy, sum(a*a) AS aa, sum(b*b) AS bb, sum(q*q) AS qq, sum(a*b) AS ab, sum(a*q) AS aq, sum(b*q) AS bq, sum(a*y) AS ay, sum(b*y) AS yb, sum(q*y) AS qy FROM c),
e AS (SELECT 'single' AS kind, 'l_discount' AS name, 1 AS p, ay*ay/aa AS x FROM s UNION ALL SELECT 'single', 'l_tax', 1, yb*yb/bb FROM s UNION ALL SELECT 'single', 'l_quantity', 1, qy*qy/qq FROM s
  UNION ALL SELECT 'joint', 'rates', 2, (ay*(bb*ay - ab*yb) + yb*(aa*yb - ab*ay))/(aa*bb - ab*ab) FROM s
  UNION ALL SELECT 'joint', 'all', 3, (ay*(ay*(bb*qq - bq*bq) - yb*(ab*qq - aq*bq) + qy*(ab*bq - aq*bb)) + yb*(-ay*(ab*qq - aq*bq) + yb*(aa*qq - aq*aq) - qy*(aa*bq - ab*aq))
    + qy*(ay*(ab*bq - aq*bb) - yb*(aa*bq - ab*aq) + qy*(aa*bb - ab*ab))) / (aa*bb*qq + 2*ab*bq*aq - aa*bq*bq - bb*aq*aq - qq*ab*ab) FROM s)
SELECT kind, name, n, 'computed' AS status, round(1 - (syy - x)/tss, 6) AS r_squared, round(1 - ((syy - x)/tss)*(n-1)/(n-k-p), 6) AS adjusted_r_squared FROM e, s"""


# --- ranked choice ----------------------------------------------------------


def newton_step(spark, d):
    """Log-likelihood, gradient and Hessian at zero of all (depth, signal) models."""
    lists = ranked_logit.prepare_lists(_long(spark, d), MODEL, "keyword_id", "value", ["c2"])
    start = {(depth, s): [0.0, 0.0] for depth in RANK_DEPTHS for s in SIGNALS}
    out = ranked_logit.newton_terms(lists, MODEL, "keyword_id", start, 2)
    return out.select(*MODEL, F.round("loglik", 4).alias("loglik"), *[F.round(element(F.col("gradient"), i), 4).alias(f"g{i}") for i in range(2)], *[F.round(element(F.col("hessian"), i), 4).alias(f"h{i}") for i in range(3)])


NEWTON_STEP = f"""WITH {_LONG}, x AS (SELECT rank_depth, signal, keyword_id, serp_rank, ln(1 + value) AS a, c2 AS b FROM long QUALIFY count(*) OVER (PARTITION BY rank_depth, signal, keyword_id) >= 2),
s AS (SELECT rank_depth, signal, a, b, count(*) OVER w AS n, avg(a) OVER w AS ma, avg(b) OVER w AS mb, avg(a*a) OVER w AS aa, avg(a*b) OVER w AS ab, avg(b*b) OVER w AS bb
  FROM x WINDOW w AS (PARTITION BY rank_depth, signal, keyword_id ORDER BY serp_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT rank_depth, signal, round(sum(-ln(n)), 4) AS loglik, round(sum(a - ma), 4) AS g0, round(sum(b - mb), 4) AS g1, round(sum(ma*ma - aa), 4) AS h0, round(sum(ma*mb - ab), 4) AS h1, round(sum(mb*mb - bb), 4) AS h2
FROM s GROUP BY 1, 2"""


def ranked_choice(spark, d):
    """Fitted rank-ordered logit of every (depth, signal) with the drift without rank 1."""
    out = ranked_logit.ranked_logit(_long(spark, d), MODEL, "keyword_id", "value", ["c2"])
    return out.select(*MODEL, "status", "n", "groups", "smallest_set", "largest_set", "converged", *[F.round(c, 5).alias(c) for c in ("log_likelihood", "coefficient", "standard_error", "p_value", "odds_ratio_per_sd", "drift")])


# --- entities and bundle ----------------------------------------------------


def entity_associations(spark, d):
    signals = build_entity_signals(*_entity_inputs(spark, d))
    out = entities.entity_associations(signals, min_tested=3)
    return out.select("entity_id", "metric", "present_page_count", "present_keyword_count", "usable_page_count", "usable_keyword_count", F.round("median_spearman_rho", 5).alias("median_rho"), F.round("ols_coefficient", 5).alias("coefficient"), "ols_covariance")


ENTITY_ASSOCIATIONS = f"""WITH {_ENTITY}, c AS (SELECT DISTINCT k, entity_id FROM m), p AS (SELECT k, u, min(p_size % 20 + 1) AS serp_rank FROM r GROUP BY 1, 2),
o AS (SELECT k, u, entity_id, count(*) AS n, avg(confidence) AS f, avg(relevance) AS g FROM m GROUP BY 1, 2, 3),
s AS (SELECT c.k, p.u, serp_rank, c.entity_id, (n IS NOT NULL)::INT AS present, coalesce(n, 0) AS n, f, g FROM c JOIN p USING (k) LEFT JOIN o ON o.k = c.k AND o.u = p.u AND o.entity_id = c.entity_id),
e AS (SELECT entity_id, sum(present) AS pages, count(DISTINCT k) FILTER (present = 1) AS kws FROM s GROUP BY 1),
l AS (SELECT entity_id, metric, k, serp_rank, value FROM s, LATERAL (VALUES ('entity_present', present::DOUBLE), ('entity_mention_count', n::DOUBLE), ('entity_confidence_mean', f), ('entity_relevance_mean', g)) t(metric, value)
  WHERE value IS NOT NULL AND (metric IN ('entity_present', 'entity_mention_count') OR present = 1)),
w AS (SELECT *, -ln(serp_rank) AS y, rank() OVER (PARTITION BY entity_id, metric, k ORDER BY value) + (count(*) OVER (PARTITION BY entity_id, metric, k, value) - 1)/2.0 AS a,
  rank() OVER (PARTITION BY entity_id, metric, k ORDER BY serp_rank) + (count(*) OVER (PARTITION BY entity_id, metric, k, serp_rank) - 1)/2.0 AS b FROM l),
q AS (SELECT entity_id, metric, k, count(*) AS n, max(value) > min(value) AS varies, CASE WHEN min(a) = max(a) OR min(b) = max(b) THEN 0 ELSE corr(a, b) END AS rho,
  count(*) * covar_pop(value, y) AS sxy, count(*) * var_pop(value) AS sxx FROM w GROUP BY 1, 2, 3),
t AS (SELECT entity_id, metric, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n >= 3 AND varies) AS kw, median(rho) FILTER (n >= 3 AND varies) AS rho, sum(sxy)/nullif(sum(sxx), 0) AS b, count(*) AS groups FROM q GROUP BY 1, 2),
v AS (SELECT entity_id, metric, max(value) > min(value) AS varies FROM l GROUP BY 1, 2)
SELECT entity_id, metric, CAST(pages AS BIGINT) AS present_page_count, kws AS present_keyword_count, n AS usable_page_count, kw AS usable_keyword_count,
  round(CASE WHEN ok THEN rho END, 5) AS median_rho, round(CASE WHEN ok THEN b END, 5) AS coefficient, CASE WHEN ok AND groups > 1 THEN 'cluster' END AS ols_covariance
FROM (SELECT *, varies AND n >= 3 AND rho IS NOT NULL AS ok FROM t JOIN v USING (entity_id, metric) JOIN e USING (entity_id))"""


def mention_associations(spark, d):
    """The same table from the mentions alone: no absence row is ever built."""
    mentions, pages, serp = _entity_inputs(spark, d)
    page = ["target_keyword_id", "canonical_url_hash"]
    seen = entity_occurrences(mentions, [*page, "entity_id"])
    ranked = pages.join(best_ranks(serp), ["run_id", *page], "inner")
    out = entities.mention_associations(seen, ranked, min_tested=3)
    return out.select("entity_id", "metric", "present_page_count", "present_keyword_count", "usable_page_count", "usable_keyword_count", F.round("median_spearman_rho", 5).alias("median_rho"), F.round("ols_coefficient", 5).alias("coefficient"), "ols_covariance")


def entity_statuses(spark, d):
    signals = build_entity_signals(*_entity_inputs(spark, d))
    out = entities.entity_associations(signals, min_tested=3)
    return out.groupBy("metric", "status").agg(F.count(F.lit(1)).alias("row_count"))


def entity_examples(spark, d):
    signals = build_entity_signals(*_entity_inputs(spark, d))
    out = entities.entity_examples(signals)
    return out.select("entity_id", F.array_join("example_urls", "|").alias("urls"), F.array_join("example_matched_texts", "|").alias("texts"))


ENTITY_EXAMPLES = f"""WITH {_ENTITY}, p AS (SELECT k, u, min(p_size % 20 + 1) AS serp_rank FROM r GROUP BY 1, 2),
o AS (SELECT k, u, entity_id, array_to_string(list_sort(list_distinct(list(matched_text))), ', ') AS t FROM m GROUP BY 1, 2, 3),
x AS (SELECT entity_id, 'u' || u AS url, t, row_number() OVER (PARTITION BY entity_id ORDER BY serp_rank, k, 'u' || u) AS i FROM o JOIN p USING (k, u))
SELECT entity_id, string_agg(url, '|' ORDER BY i) AS urls, string_agg(t, '|' ORDER BY i) AS texts FROM x WHERE i <= 3 GROUP BY 1"""


def depth_bundle(spark, d):
    """All statistics of all depths and signals with the actionable flag."""
    panel = st.panel(spark, d).withColumns({"c1": F.ln("l_extendedprice"), "c2": (F.col("url_id") % 13).cast("double")})
    out = bundle.association_table(panel, SIGNALS, CONTROLS, key="keyword_id")
    return out.select("rank_depth", "signal", "n", "groups", "status", "mode", F.round("median_rho", 5).alias("median_rho"), F.round("coefficient", 5).alias("coefficient"), "actionable")


def tail_probabilities(spark, d):
    """Tails of three distributions with arguments from the line items."""
    rows = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("t"))
    q = F.col("l_quantity")
    return rows.select("l_quantity", F.round(t_two_sided(q / 10, F.lit(1.0)), 6).alias("t_1"), F.round(t_two_sided(q / 10, F.lit(2.0)), 6).alias("t_2"), F.round(f_tail(q / 10, F.lit(2.0), F.lit(10.0)), 6).alias("f_2_10"), F.round(chi2_tail(q / 5, F.lit(2.0)), 6).alias("chi_2"), F.round(chi2_tail(q / 5, F.lit(4.0)), 6).alias("chi_4"))


TAIL_PROBABILITIES = """SELECT DISTINCT l_quantity, round(1 - 2 / pi() * atan(l_quantity / 10), 6) AS t_1, round(1 - (l_quantity / 10) / sqrt(2 + pow(l_quantity / 10, 2)), 6) AS t_2,
  round(pow(1 + 2 * (l_quantity / 10) / 10, -5), 6) AS f_2_10, round(exp(-l_quantity / 10), 6) AS chi_2, round(exp(-l_quantity / 10) * (1 + l_quantity / 10), 6) AS chi_4 FROM lineitem"""


QUERIES = {
    "correlations": (correlations, CORRELATIONS),
    "correlations_whole": (correlations_whole, CORRELATIONS_WHOLE),
    "correlation_summary": (correlation_summary, CORRELATION_SUMMARY),
    "false_discovery": (false_discovery, FALSE_DISCOVERY),
    "adjusted_correlations": (adjusted_correlations, None),
    "slopes": (slopes, SLOPES),
    "regressions": (regressions, REGRESSIONS),
    "clustered_inference": (clustered_inference, None),
    "single_list_inference": (single_list_inference, SINGLE_LIST_INFERENCE),
    "two_way": (two_way, TWO_WAY),
    "effect_sizes": (effect_sizes, EFFECT_SIZES),
    "model_status": (model_status, MODEL_STATUS),
    "influence": (influence, INFLUENCE),
    "influence_counts": (influence_counts, None),
    "influence_refit": (influence_refit, INFLUENCE_REFIT),
    "specification": (specification, SPECIFICATION),
    "inflation": (inflation, INFLATION),
    "joint_model": (joint_model, None),
    "explainability": (explainability, EXPLAINABILITY),
    "newton_step": (newton_step, NEWTON_STEP),
    "ranked_choice": (ranked_choice, None),
    "entity_associations": (entity_associations, ENTITY_ASSOCIATIONS),
    "mention_associations": (mention_associations, ENTITY_ASSOCIATIONS),
    "entity_statuses": (entity_statuses, None),
    "entity_examples": (entity_examples, ENTITY_EXAMPLES),
    "depth_bundle": (depth_bundle, None),
    "tail_probabilities": (tail_probabilities, TAIL_PROBABILITIES),
}
