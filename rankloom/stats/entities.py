"""Association of each entity's presence and weight with rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numeric import rank_outcome
from rankloom.operators.groups import first_per_key, group_percentiles, join_null_safe, top_per_key
from rankloom.session import cut_lineage
from rankloom.stats.moments import group_moments
from rankloom.stats.regression import slopes_from_moments
from rankloom.stats.spearman import adjust_p_values, correlation_p_value, keyword_correlations

# Metrics and eligibility.
METRICS = ("entity_present", "entity_mention_count", "entity_confidence_mean", "entity_relevance_mean")
MIN_PAGES, MIN_KEYWORDS, MIN_TESTED_KEYWORDS, MAX_Q = 10, 3, 10, 0.05

_PAGE = ["target_keyword_id", "canonical_url_hash"]


def _melted(pages: DataFrame, entity: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``(entity, metric, keyword, rank, value, outcome)`` of the values that are there."""
    wide = pages.select(*entity, "target_keyword_id", "serp_rank", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot([*entity, "target_keyword_id", "serp_rank"], list(metrics), "metric", "value")
    return long.where("value is not null and serp_rank is not null").withColumn("outcome", rank_outcome(F.col("serp_rank")))


def _by_keyword(long: DataFrame, metric: Sequence[str], bounded: bool) -> DataFrame:
    """``(metric, keyword, n, low, high, rho, p_value, cross)`` from the rows themselves."""
    keyword = [*metric, "target_keyword_id"]
    ranges = long.groupBy(*keyword).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    tests = keyword_correlations(long, keyword, "value", bounded=bounded, min_rows=3).drop("n_rows")
    moments = group_moments(long, metric, "target_keyword_id", ["value", "outcome"]).drop("means")
    joined = join_null_safe(join_null_safe(moments, ranges, keyword, "inner"), tests, keyword, "left")
    return joined.select(*keyword, "n", "low", "high", "rho", "p_value", "cross")


def _associate(
    keywords: DataFrame,
    eligibility: DataFrame,
    scope: Sequence[str],
    min_pages: int,
    min_keywords: int,
    min_tested: int,
    max_q: float,
) -> DataFrame:
    """Results per entity and metric from the per-keyword table."""
    entity, metric = [*scope, "entity_id"], [*scope, "entity_id", "metric"]
    keywords = cut_lineage(keywords)
    usable = (F.col("n") >= 3) & (F.col("low") < F.col("high"))
    totals = keywords.groupBy(*metric).agg(
        F.sum("n").alias("usable_page_count"),
        F.count_if(usable).alias("usable_keyword_count"),
        (F.min("low") < F.max("high")).alias("__varies"),
    )
    tested = keywords.where(usable)
    slopes = slopes_from_moments(keywords, metric).select(
        *metric, "groups", F.col("coefficient").alias("ols_coefficient"), F.col("p_value").alias("ols_p_value")
    )
    joined = totals
    for part in (
        group_percentiles(tested, metric, "rho", {"median_spearman_rho": 0.5}),
        group_percentiles(tested, metric, "p_value", {"median_p_value": 0.5}),
        slopes,
    ):
        joined = join_null_safe(joined, part, metric, "left")
    joined = join_null_safe(joined, eligibility, entity, "left")
    counted = joined.withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("present_page_count", "present_keyword_count")}
    )
    estimable = F.col("__varies") & (F.col("usable_page_count") >= 3) & F.col("median_spearman_rho").isNotNull()
    eligible = (F.col("present_page_count") >= min_pages) & (F.col("present_keyword_count") >= min_keywords)
    status = (
        F.when(~estimable, "non-estimable")
        .when(~eligible | (F.col("usable_keyword_count") < min_tested), "underpowered")
        .when(F.col("ols_p_value").isNull(), "non-estimable")
        .otherwise("non-significant")
    )
    stated = counted.withColumns({"status": status, "ols_covariance": F.when(estimable & (F.col("groups") > 1), "cluster")})
    found = ("median_spearman_rho", "median_p_value", "ols_coefficient", "ols_p_value")
    stated = stated.withColumns({f"__{c}": F.when(estimable, F.col(c)) for c in found})
    stated = stated.withColumn("__p", F.when(F.col("status") == "non-significant", F.col("__ols_p_value")))
    adjusted = adjust_p_values(stated, [*scope, "metric"], "__p")
    return adjusted.select(
        *metric,
        "present_page_count",
        "present_keyword_count",
        "usable_page_count",
        "usable_keyword_count",
        *[F.col(f"__{c}").alias(c) for c in found],
        "ols_covariance",
        "bh_q_value",
        F.when(F.col("bh_q_value") <= max_q, "significant").otherwise(F.col("status")).alias("status"),
    )


def _eligibility(present: DataFrame, entity: Sequence[str]) -> DataFrame:
    return present.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("present_page_count"),
        F.count_distinct("target_keyword_id").alias("present_keyword_count"),
    )


def entity_associations(
    signals: DataFrame,
    scope: Sequence[str] = (),
    min_pages: int = MIN_PAGES,
    min_keywords: int = MIN_KEYWORDS,
    min_tested: int = MIN_TESTED_KEYWORDS,
    max_q: float = MAX_Q,
    bounded: bool = True,
) -> DataFrame:
    """One row per entity and metric: rank correlation, slope, q-value and status.

    ``signals`` is the presence mart with its explicit absence rows.  Presence and
    count use all pages, the mean metrics only pages with the entity.  ``scope`` adds
    grouping columns such as the rank depth.
    """
    entity = [*scope, "entity_id"]
    # Read by every part below.
    pages = cut_lineage(
        first_per_key(signals, [*entity, *_PAGE], [F.col("serp_rank").asc(), F.col("url").asc()]).select(
            *entity, *_PAGE, "serp_rank", *METRICS
        )
    )
    present = pages.where("entity_present = 1")
    long = _melted(pages, entity, METRICS[:2]).unionByName(_melted(present, entity, METRICS[2:]))
    keywords = _by_keyword(long, [*entity, "metric"], bounded)
    return _associate(keywords, _eligibility(present, entity), scope, min_pages, min_keywords, min_tested, max_q)


def _with_absences(present: DataFrame, pages: DataFrame, scope: Sequence[str], entity: Sequence[str]) -> DataFrame:
    """The per-keyword table of presence and count without any absence row.

    A page without the entity has value 0, so every sum over all pages of a keyword
    is the sum over the pages with the entity plus something known from the keyword
    alone.  In rank order the absent pages come first and share one average rank.
    """
    key = [*scope, "target_keyword_id"]
    b = F.rank().over(Window.partitionBy(*key).orderBy("serp_rank")) + (
        F.count(F.lit(1)).over(Window.partitionBy(*key, "serp_rank")) - 1
    ) / 2.0
    ranked = pages.select(*scope, *_PAGE, "serp_rank", rank_outcome(F.col("serp_rank")).alias("y"), b.alias("b"))
    y, b = F.col("y"), F.col("b")
    totals = ranked.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("N"),
        F.sum(y).alias("Y"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("YY"),
        F.sum(b).alias("B"),
        (F.var_pop(b) * F.count(F.lit(1))).alias("BB"),
        (F.min("serp_rank") == F.max("serp_rank")).alias("level"),
    )
    own = [*entity, "target_keyword_id"]
    rows = present.select(*entity, *_PAGE, F.col("entity_mention_count").cast("double").alias("x"))
    seen = rows.join(ranked.drop("serp_rank"), [*scope, *_PAGE], "inner")
    a = F.rank().over(Window.partitionBy(*own).orderBy("x")) + (
        F.count(F.lit(1)).over(Window.partitionBy(*own, "x")) - 1
    ) / 2.0
    m = F.count(F.lit(1)).cast("double")

    def sums(value: Column, place: Column) -> list[Column]:
        return [
            m.alias("M"),
            F.sum(value).alias("X"),
            F.sum(value * value).alias("XX"),
            F.sum(value * y).alias("XY"),
            F.min(value).alias("least"),
            F.max(value).alias("high"),
            F.sum(b).alias("PB"),
            F.sum(place).alias("A"),
            F.sum(place * place).alias("AA"),
            F.sum(place * b).alias("AB"),
        ]

    placed = seen.withColumn("a", a)
    counts = placed.groupBy(*own).agg(*sums(F.col("x"), F.col("a"))).withColumn("metric", F.lit(METRICS[1]))
    level = placed.withColumn("half", (F.count(F.lit(1)).over(Window.partitionBy(*own)) + 1) / 2.0)
    flags = level.groupBy(*own).agg(*sums(F.lit(1.0), F.col("half"))).withColumn("metric", F.lit(METRICS[0]))
    both = join_null_safe(counts.unionByName(flags), totals, key, "inner")
    n, absent = F.col("N"), F.col("N") - F.col("M")
    first = (absent + 1) / 2.0
    sum_a = n * (n + 1) / 2.0
    sum_aa = absent * first * first + F.col("M") * absent * absent + 2.0 * absent * F.col("A") + F.col("AA")
    sum_ab = first * (F.col("B") - F.col("PB")) + absent * F.col("PB") + F.col("AB")
    spread = (sum_aa - sum_a * sum_a / n) * F.col("BB")
    raw = (sum_ab - sum_a * F.col("B") / n) / F.sqrt(F.when(spread > 0, spread))
    low = F.when(absent > 0, F.lit(0.0)).otherwise(F.col("least"))
    flat = F.col("level") | (low == F.col("high"))
    rho = F.when(flat, F.lit(0.0)).when(F.abs(raw) < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    cross = F.array(
        F.greatest(F.col("XX") - F.col("X") * F.col("X") / n, F.lit(0.0)), F.col("XY") - F.col("X") * F.col("Y") / n, F.col("YY")
    )
    out = both.select(
        *entity,
        "metric",
        "target_keyword_id",
        n.cast("bigint").alias("n"),
        low.alias("low"),
        "high",
        F.when(n >= 3, rho).alias("rho"),
        flat.alias("__flat"),
        cross.alias("cross"),
    )
    return out.withColumn("p_value", F.when(F.col("n") >= 3, correlation_p_value("rho", "n", "__flat"))).drop("__flat")


def mention_associations(
    mentions: DataFrame,
    pages: DataFrame,
    scope: Sequence[str] = (),
    min_pages: int = MIN_PAGES,
    min_keywords: int = MIN_KEYWORDS,
    min_tested: int = MIN_TESTED_KEYWORDS,
    max_q: float = MAX_Q,
    bounded: bool = True,
) -> DataFrame:
    """The same results from the mentions alone, without the presence mart.

    ``mentions`` has one row per entity and page with the entity; ``pages`` has the
    usable pages of every keyword with their rank.  The work grows with the mentions,
    not with entities times pages.
    """
    entity = [*scope, "entity_id"]
    pages = cut_lineage(
        first_per_key(pages, [*scope, *_PAGE], [F.col("serp_rank").asc()]).select(*scope, *_PAGE, "serp_rank")
    )
    present = cut_lineage(
        mentions.select(*entity, *_PAGE, *METRICS[1:]).join(pages, [*scope, *_PAGE], "inner")
    )
    means = _by_keyword(_melted(present, entity, METRICS[2:]), [*entity, "metric"], bounded)
    zeros = _with_absences(present, pages, scope, entity)
    return _associate(
        means.unionByName(zeros), _eligibility(present, entity), scope, min_pages, min_keywords, min_tested, max_q
    )


def entity_examples(signals: DataFrame, scope: Sequence[str] = (), count: int = 3) -> DataFrame:
    """The best-ranked pages of each entity as parallel arrays."""
    entity = [*scope, "entity_id"]
    pages = first_per_key(
        signals.where("entity_present = 1"), [*entity, *_PAGE], [F.col("serp_rank").asc(), F.col("url").asc()]
    )
    top = top_per_key(pages, entity, [F.col(c).asc() for c in ("serp_rank", "target_keyword", "url")], count, "position")
    # At most ``count`` rows per entity are left.
    rows = F.array_sort(F.collect_list(F.struct("position", "url", "matched_texts", "entity_types")))
    return top.groupBy(*entity).agg(rows.alias("r")).select(
        *entity,
        F.transform("r", lambda e: e["url"]).alias("example_urls"),
        F.transform("r", lambda e: F.array_join(e["matched_texts"], ", ")).alias("example_matched_texts"),
        F.transform("r", lambda e: F.array_join(e["entity_types"], ", ")).alias("example_entity_types"),
    )
