"""Queries for factor screening, Shapley shares, cross-validation and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.importance import bootstrap, crossval, factors, ranking, report, screening, shapley
from rankloom.plans import standins as st
from rankloom.plans.standins import table

FACTORS = {"rates": ["l_discount", "l_tax"], "volume": ["l_quantity"], "part": ["p_size", "p_retailprice"]}


def _panel(spark, d):
    """The panel with part attributes; sizes that are multiples of 9 are missing."""
    rows = st.panel(spark, d)
    part = table(spark, d, "part").selectExpr("p_partkey AS url_id", "if(p_size % 9 = 0, NULL, p_size) AS p_size", "p_retailprice", "p_brand")
    return rows.join(part, "url_id", "left").withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "url_id"))


_PANEL = f"""{st.PANEL}, ip AS (SELECT panel.*, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice, p_brand,
  l_orderkey || '-' || l_linenumber || '-' || url_id AS row_id FROM panel LEFT JOIN part ON p_partkey = url_id)"""


def ndcg(spark, d):
    """nDCG of the quantity as a predictor of each supplier's ranked list."""
    lists = ranking.list_ndcg(_panel(spark, d), [], "keyword_id", "serp_rank", "l_quantity", "row_id")
    return lists.select("keyword_id", F.round("ndcg", 6).alias("ndcg"))


NDCG = f"""WITH {_PANEL}, g AS (SELECT keyword_id, pow(2, max(serp_rank) OVER k + 1 - serp_rank) - 1 AS gain,
  row_number() OVER (PARTITION BY keyword_id ORDER BY l_quantity DESC, row_id) AS i, row_number() OVER (PARTITION BY keyword_id ORDER BY serp_rank) AS j, count(*) OVER k AS n FROM ip WINDOW k AS (PARTITION BY keyword_id))
SELECT keyword_id, round(sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) ELSE 0 END) / sum(CASE WHEN j <= 10 THEN gain / log2(j + 1) ELSE 0 END), 6) AS ndcg FROM g WHERE n >= 2 GROUP BY 1"""


def pooled_quality(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_returnflag", "l_extendedprice AS y", "l_quantity * 1500 AS p")
    out = ranking.pooled_r_squared(rows, ["l_returnflag"], "y", "p")
    return out.withColumn("r_squared", F.round("r_squared", 6))


POOLED_QUALITY = """SELECT l_returnflag, round(1 - sum(pow(l_extendedprice - l_quantity * 1500, 2)) / (count(*) * var_pop(l_extendedprice)), 6) AS r_squared FROM lineitem GROUP BY 1"""


def screened(spark, d):
    """Screening outcome of each column, with a copy and a mostly missing column added."""
    rows = _panel(spark, d).withColumns({"copy": F.col("l_tax") * 3 + F.col("l_discount") * 1e-4, "rare": F.expr("if(l_quantity > 45, 1.0, NULL)")})
    result = screening.screen(rows, {**FACTORS, "more": ["copy", "rare"]}, (), "keyword_id")
    out = [(c, "selected") for c in result.selected] + result.excluded
    return spark.createDataFrame(out, "column_name string, outcome string")


def factor_r_squared(spark, d):
    """In-sample and partial R squared of each factor from one matrix of cross products."""
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS keyword_id", "l_linenumber AS serp_rank", "l_discount", "l_tax", "l_quantity")
    kinds = {"discount": ["l_discount"], "tax": ["l_tax"], "quantity": ["l_quantity"]}
    found = screening.group_r_squared(screening.screen(rows, kinds, (), "keyword_id"), kinds)
    return spark.createDataFrame([(f, *v) for f, v in found.items()], "factor string, full_r2 double, reduced_r2 double, partial_r2 double").select(
        "factor", *[F.round(c, 6).alias(c) for c in ("full_r2", "reduced_r2", "partial_r2")]
    )


FACTOR_R_SQUARED = """WITH c AS (SELECT -ln(l_linenumber) - avg(-ln(l_linenumber)) OVER w AS y, l_discount - avg(l_discount) OVER w AS a, l_tax - avg(l_tax) OVER w AS b, l_quantity - avg(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
s AS (SELECT sum(y*y) AS yy, sum(a*a) AS aa, sum(b*b) AS bb, sum(q*q) AS qq, sum(a*b) AS ab, sum(a*q) AS aq, sum(b*q) AS bq, sum(a*y) AS ay, sum(b*y) AS yb, sum(q*y) AS qy FROM c),
f AS (SELECT *, (ay*(ay*(bb*qq - bq*bq) - yb*(ab*qq - aq*bq) + qy*(ab*bq - aq*bb)) + yb*(-ay*(ab*qq - aq*bq) + yb*(aa*qq - aq*aq) - qy*(aa*bq - ab*aq))
  + qy*(ay*(ab*bq - aq*bb) - yb*(aa*bq - ab*aq) + qy*(aa*bb - ab*ab))) / (aa*bb*qq + 2*ab*bq*aq - aa*bq*bq - bb*aq*aq - qq*ab*ab) / yy AS r FROM s),
g AS (SELECT 'discount' AS factor, r, (yb*(qq*yb - bq*qy) + qy*(bb*qy - bq*yb))/(bb*qq - bq*bq)/yy AS x FROM f UNION ALL SELECT 'tax', r, (ay*(qq*ay - aq*qy) + qy*(aa*qy - aq*ay))/(aa*qq - aq*aq)/yy FROM f
  UNION ALL SELECT 'quantity', r, (ay*(bb*ay - ab*yb) + yb*(aa*yb - ab*ay))/(aa*bb - ab*ab)/yy FROM f)
SELECT factor, round(r, 6) AS full_r2, round(x, 6) AS reduced_r2, round((r - x)/(1 - x), 6) AS partial_r2 FROM g"""


def shapley_shares(spark, d):
    result = screening.screen(_panel(spark, d), FACTORS, (), "keyword_id")
    draws = shapley.shapley_contributions(spark, result, FACTORS, 400)
    return shapley.shapley_summary(draws, 400).withColumns({c: F.round(c, 6) for c in ("shapley_value", "monte_carlo_error", "half_difference", "shapley_share")})


def fold_sizes(spark, d):
    """Balanced folds: suppliers per repeat and fold."""
    units = crossval.assign_folds(table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey", 5, 3)
    spread = units.select("l_suppkey", F.posexplode("cells").alias("repeat", "code")).withColumn("fold", F.floor(F.col("code") / 3))
    return spread.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("units"))


FOLD_SIZES = """WITH n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)
SELECT r AS repeat, f AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS units FROM n, range(3) a(r), range(5) b(f)"""


def _validated(spark, d, unit=None, repeats=3):
    return crossval.cross_validate(_panel(spark, d), FACTORS, "keyword_id", "serp_rank", unit, "row_id", (), 5, repeats)


def out_of_fold(spark, d):
    """Losses of every repeat when a factor is left out."""
    cv = _validated(spark, d)
    out = crossval.validated_quality(cv)
    return out.select("repeat", "factor", *[F.round(c, 6).alias(c) for c in ("full_r2", "reduced_r2", "delta_r2", "delta_ndcg")])


def repeat_spread(spark, d):
    cv = _validated(spark, d)
    out = crossval.repeat_spread(crossval.validated_quality(cv))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("factor", "repeats")})


def domain_holdout(spark, d):
    """Brands as domains: whole brands are held out."""
    cv = _validated(spark, d, "p_brand", 2)
    out = crossval.validated_quality(cv, per_repeat=False)
    return out.select("factor", *[F.round(c, 6).alias(c) for c in ("full_r2", "reduced_r2", "delta_r2")])


def bootstrap_intervals(spark, d):
    cv = _validated(spark, d)
    out = bootstrap.validated_intervals(cv, draws=100)
    return out.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


def metadata_only(spark, d):
    out = report.metadata_only(_panel(spark, d), ["p_size", "p_retailprice"], "keyword_id", "serp_rank", "row_id", repeats=2)
    return out.withColumns({c: F.round(c, 6) for c in ("r_squared", "ndcg")})


def relative_importance(spark, d):
    out = report.relative_importance(_panel(spark, d), FACTORS, "keyword_id", "serp_rank", "row_id", "p_brand", (), repeats=2, draws=50, permutations=100, domain_repeats=2)
    return out.select("factor", "selected_signals", *[F.round(c, 6).alias(c) for c in ("partial_r2", "shapley_share", "oos_delta_r2", "oos_delta_ndcg", "domain_delta_r2")], "evidence_status", "ndcg_evidence_status")


def family_coverage(spark, d):
    """Registry columns that the part-derived on-page table really fills, by family."""
    from rankloom.operators.signals import onpage_signals

    signals = onpage_signals(st.onpage_lake(spark, d))
    names = [s for s in factors.family_signals(["onpage_content_quality", "onpage_core_web_vitals"]) if s in signals.columns]
    from rankloom.operators.quality import metric_coverage

    filled = metric_coverage(signals, names).withColumnRenamed("column_name", "signal")
    return factors.family_table(spark).join(filled, "signal").groupBy("family", "kind", "source_mart").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("non_null_count").alias("values")
    )


FAMILY_COVERAGE = """SELECT 'onpage_content_quality' AS family, 'onpage_metric' AS kind, 'onpage_features' AS source_mart, CAST(10 AS BIGINT) AS signals, 2 * count(*) AS "values" FROM part
UNION ALL SELECT 'onpage_core_web_vitals', 'onpage_metric', 'onpage_features', 8, 0"""


def evidence_labels(spark, d):
    """Labels from intervals made of supplier balances."""
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal / 1000 AS b", "s_suppkey % 7 <> 0 AS tested", "if(s_suppkey % 5 = 0, NULL, s_nationkey - 12.0) AS g")
    b, g = F.col("b"), F.col("g")
    label = report.evidence_status(F.col("tested"), b, b - 2, b + 2, g, g - 5, g + 5)
    return rows.select("s_suppkey", label.alias("evidence"), report.ndcg_status(F.col("tested"), b, b - 1, b + 1).alias("ndcg_evidence"))


EVIDENCE_LABELS = """WITH r AS (SELECT s_suppkey, s_acctbal / 1000 AS b, s_suppkey % 7 <> 0 AS tested, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey - 12.0 END AS g FROM supplier)
SELECT s_suppkey, CASE WHEN NOT tested THEN 'Not tested' WHEN b <= 0 THEN 'Redundant/no value' WHEN b + 2 < 0 THEN 'Redundant/no value' WHEN b - 2 <= 0 THEN 'Uncertain' WHEN g IS NULL THEN 'Uncertain'
  WHEN g + 5 < 0 THEN 'Harmful to portability' WHEN g < 0 THEN 'Dataset-specific' WHEN g - 5 > 0 THEN 'Portable' ELSE 'Keyword-supported' END AS evidence,
  CASE WHEN NOT tested THEN 'Not tested' WHEN b <= 0 THEN 'Redundant/no value' WHEN b - 1 > 0 THEN 'Keyword-supported' ELSE 'Uncertain' END AS ndcg_evidence FROM r"""


QUERIES = {
    "ndcg": (ndcg, NDCG),
    "pooled_quality": (pooled_quality, POOLED_QUALITY),
    "screened_predictors": (screened, None),
    "factor_r_squared": (factor_r_squared, FACTOR_R_SQUARED),
    "shapley_shares": (shapley_shares, None),
    "fold_sizes": (fold_sizes, FOLD_SIZES),
    "out_of_fold": (out_of_fold, None),
    "out_of_fold_spread": (repeat_spread, None),
    "domain_holdout": (domain_holdout, None),
    "bootstrap_intervals": (bootstrap_intervals, None),
    "metadata_only": (metadata_only, None),
    "relative_importance": (relative_importance, None),
    "family_coverage": (family_coverage, FAMILY_COVERAGE),
    "evidence_labels": (evidence_labels, EVIDENCE_LABELS),
}
