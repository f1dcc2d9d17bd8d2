"""Feature marts and the analysis mart."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import schemas as S
from rankloom.functions.numeric import all_present, any_present, finite, row_mean, zscore
from rankloom.functions.text import hostname, stable_id
from rankloom.operators.filters import with_null_columns
from rankloom.operators.groups import GROUP_ROWS_PER_TASK, attach_group_stats, group_medians, join_measured, join_null_safe
from rankloom.operators.ranks import _moments, ordinal_ranks
from rankloom.session import cut_lineage, store_columns

PAGE_KEY = ["run_id", "target_keyword_id", "canonical_url_hash"]
KEYWORD_KEY = ["run_id", "target_keyword_id", "target_keyword"]
SCORE_COLUMNS = [f"{s}_{k}_score" for s in S.SCORERS for k in ("raw", "normalized")]

# Components of the size score and of the authority score.
SIZE_COLUMNS = (
    "images_size",
    "scripts_size",
    "stylesheets_size",
    "total_transfer_size",
    "total_dom_size",
    "internal_links_count",
)
AUTHORITY_CONTINUOUS = (
    "time_to_first_byte_ms",
    "largest_contentful_paint_ms",
    "cumulative_layout_shift",
    "first_input_delay_ms",
    "resource_errors_count",
    "render_blocking_scripts_count",
    "render_blocking_stylesheets_count",
)
AUTHORITY_INVERTED = ("meta_charset_consistency", "canonical", "is_https", "has_meta_title")
AUTHORITY_FLAGS = (
    "title_too_long",
    "title_too_short",
    "no_title",
    "no_description",
    "no_h1_tag",
    "has_render_blocking_resources",
    "duplicate_meta_tags",
    "irrelevant_description",
    "low_readability_rate",
    "is_4xx_code",
    "is_5xx_code",
    "is_broken",
    "no_content_encoding",
    "high_loading_time",
    "high_waiting_time",
    "no_doctype",
    "no_encoding_meta_tag",
    "https_to_http_links",
    "size_greater_than_3mb",
    "has_meta_refresh_redirect",
    "low_content_rate",
    "large_page_size",
    "irrelevant_title",
    "irrelevant_meta_keywords",
    "deprecated_html_tags",
    "duplicate_title_tag",
    "no_image_alt",
    "broken_links",
    "broken_resources",
    "duplicate_description",
    "duplicate_title",
)


def by_list(frame: DataFrame) -> DataFrame:
    """Rows dealt out by their keyword, whose ranked lists are cut at the depth.

    Joins on any key with the keyword and windows over lists then move no row of frames that were dealt out so, while
    each join of other keys would shuffle all of them once more and keep what the joins before it shuffled.  The run
    is left out: where it is a constant, the plan would not know it as a key.
    """
    return frame.repartition("target_keyword_id")


def keyword_serp(keywords: DataFrame, serp_items: DataFrame) -> DataFrame:
    return keywords.drop("schema_version").join(serp_items, KEYWORD_KEY, "inner").select(
        *KEYWORD_KEY,
        "keyword_order",
        "source_response_id",
        "serp_item_id",
        "canonical_url_hash",
        "url",
        "serp_rank",
        "title",
        "description",
        "schema_version",
    )


def page_features(pages: DataFrame, similarity: DataFrame) -> DataFrame:
    scores = similarity.select(*PAGE_KEY, *SCORE_COLUMNS)
    return pages.join(scores, PAGE_KEY, "inner").select(
        *KEYWORD_KEY,
        "page_id",
        "response_id",
        "canonical_url_hash",
        "url",
        "title",
        F.length("text").cast("bigint").alias("page_text_length"),
        *SCORE_COLUMNS,
        "schema_version",
    )


def passage_features(passages: DataFrame) -> DataFrame:
    return passages.select(
        *KEYWORD_KEY,
        "page_id",
        "response_id",
        "passage_id",
        "canonical_url_hash",
        "url",
        "source",
        "word_count",
        F.length("text").cast("bigint").alias("passage_text_length"),
        "schema_version",
    )


def two_level(
    frame: DataFrame,
    medians: Sequence[str],
    rates: Sequence[str] = (),
    group: Sequence[str] = ("run_id", "domain"),
    unit: str = "canonical_url_hash",
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Median (numbers) or mean (flags) per page, then the same over the pages of a group.

    The rows are read once, into extremes per page: those of a page with one or two rows, or with a single value, give
    its median.  Rows are read again only for other pages.
    """
    keys = [*group, unit]
    least, most = (lambda c: F.col(f"__least_{c}")), (lambda c: F.col(f"__most_{c}"))
    ends = [f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in medians for n, f in (("least", F.min), ("most", F.max))]
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in rates]
    pages = store_columns(frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *ends, *means))
    if limit is not None:
        # A group holds at least the rows of its pages: no oversized group, no oversized page.
        heavy = pages.groupBy(*group).agg(F.sum("__rows").alias("__rows")).where(F.col("__rows") > limit)
        limit = None if heavy.isEmpty() else limit
    varied = [F.coalesce(least(c) < most(c), F.lit(False)) for c in medians]
    undecided = (F.col("__rows") > 2) & reduce(or_, varied, F.lit(False))
    counted = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(undecided).alias("undecided")).first()
    middle = [F.when(least(c) == most(c), least(c)).otherwise(0.5 * least(c) + 0.5 * most(c)).alias(c) for c in medians]
    per_page = pages.where(~undecided).select(*keys, *middle, *rates)
    if 2 * counted["undecided"] > counted["pages"]:
        per_page = group_medians(frame, keys, medians, rates, limit)
    elif counted["undecided"]:
        rows = join_null_safe(frame, pages.where(undecided).select(*keys), keys, "left_semi")
        per_page = per_page.unionByName(group_medians(rows, keys, medians, rates, limit))
    return group_medians(per_page, group, medians, rates, limit)


def _standardised(frame: DataFrame, columns: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """``__z_<name>``: z-score of each transformed column, 0 where nothing varies."""
    named = frame.select("*", *[finite(c.cast("double")).alias(f"__t_{n}") for n, c in columns.items()])
    temp = [f"__t_{n}" for n in columns]
    stats = attach_group_stats(named, keys, _moments(temp))
    return stats.select(
        *frame.columns,
        *[
            zscore(F.col(t), F.col(f"__mean_{t}"), F.col(f"__sd_{t}"), F.lit(0.0)).alias(f"__z_{n}")
            for n, t in zip(columns, temp)
        ],
    )


def domain_scores(
    frame: DataFrame,
    sizes: Sequence[str] = (),
    continuous: Sequence[str] = (),
    inverted: Sequence[str] = (),
    flags: Sequence[str] = (),
    run: Sequence[str] = ("run_id",),
    domain: str = "domain",
    page: str = "canonical_url_hash",
) -> DataFrame:
    """``site_scale`` and ``authority_proxy`` of every domain from one pair of aggregates.

    Components that are not columns of the frame count as unknown.
    """
    columns = set(frame.columns)
    numbers = [c for c in dict.fromkeys((*sizes, *continuous)) if c in columns]
    rates = [c for c in (*inverted, *flags) if c in columns]
    levels = two_level(frame, numbers, rates, [*run, domain], page)
    signals = {f"a_{c}": F.asinh(F.col(c)) for c in continuous if c in columns} | {f"a_{c}": F.col(c) for c in rates}
    logs = {f"s_{c}": F.log1p(F.col(c)) for c in sizes if c in columns}
    z = _standardised(levels, logs | signals, run)
    known = all_present([F.col(c) for c in sizes]) if sizes and set(sizes) <= columns else F.lit(False)
    scale = F.when(known, row_mean([F.col(f"__z_{n}") for n in logs])) if logs else F.lit(None).cast("double")
    turned = {f"a_{c}" for c in inverted}
    aligned = [-F.col(f"__z_{n}") if n in turned else F.col(f"__z_{n}") for n in signals]
    authority = F.when(any_present(aligned), -row_mean(aligned)) if aligned else F.lit(None).cast("double")
    return z.select(*run, domain, scale.alias("site_scale"), authority.alias("authority_proxy"))


def site_scale(frame: DataFrame, columns: Sequence[str] = SIZE_COLUMNS, **names) -> DataFrame:
    """Mean z-score of the log sizes of a domain; null unless every size is known."""
    return domain_scores(frame, sizes=columns, **names).drop("authority_proxy")


def authority_proxy(
    frame: DataFrame,
    continuous: Sequence[str] = AUTHORITY_CONTINUOUS,
    inverted: Sequence[str] = AUTHORITY_INVERTED,
    flags: Sequence[str] = AUTHORITY_FLAGS,
    **names,
) -> DataFrame:
    """Negated mean z-score of negative signals; higher means fewer of them."""
    return domain_scores(frame, (), continuous, inverted, flags, **names).drop("site_scale")


def domain_rollup(serp_items: DataFrame) -> DataFrame:
    return (
        serp_items.withColumn("domain", hostname("url"))
        .groupBy(*KEYWORD_KEY, "domain")
        .agg(
            F.count(F.lit(1)).alias("serp_item_count"),
            F.min("serp_rank").alias("best_serp_rank"),
            F.max("serp_rank").alias("worst_serp_rank"),
        )
    )


def scored_domains(serp_items: DataFrame, onpage: DataFrame) -> DataFrame:
    """Both scores of every (run, domain), from one pass over the ranked pages and their signals."""
    wanted = dict.fromkeys((*SIZE_COLUMNS, *AUTHORITY_CONTINUOUS, *AUTHORITY_INVERTED, *AUTHORITY_FLAGS))
    present = [c for c in wanted if c in onpage.columns]
    measured = serp_items.select(*PAGE_KEY, hostname("url").alias("domain")).join(
        onpage.select(*PAGE_KEY, *present), PAGE_KEY, "left"
    )
    return domain_scores(measured, SIZE_COLUMNS, AUTHORITY_CONTINUOUS, AUTHORITY_INVERTED, AUTHORITY_FLAGS)


def domain_features(serp_items: DataFrame, onpage: DataFrame) -> DataFrame:
    """Domain rollup with both domain scores."""
    scores = scored_domains(serp_items, onpage)
    rollup = domain_rollup(serp_items).withColumn(
        "domain_feature_id", stable_id("run_id", "target_keyword_id", "domain")
    )
    return (
        join_measured(rollup, scores, ["run_id", "domain"], "left")
        .select(
            *KEYWORD_KEY,
            "domain_feature_id",
            "domain",
            "serp_item_count",
            "best_serp_rank",
            "worst_serp_rank",
            "site_scale",
            "authority_proxy",
            F.lit(S.FEATURE_VERSION).alias("schema_version"),
        )
    )


def panel_rows(serp: DataFrame, page_feats: DataFrame, domain_feats: DataFrame) -> DataFrame:
    """Ranked rows with a scored page and a domain that has both controls."""
    scored = page_feats.select(*PAGE_KEY, "url")
    controlled = domain_feats.where("site_scale is not null and authority_proxy is not null").select(
        "run_id", F.col("domain").alias("__domain")
    ).distinct()
    ranked = serp.join(scored, [*PAGE_KEY, "url"], "left_semi").withColumn("__domain", hostname("url"))
    return join_measured(ranked, controlled, ["run_id", "__domain"], "left_semi").select(*serp.columns)


PAGE_CONTROLS = {
    "deprecated_html_tags": "boolean",
    "meta_keywords_to_content_consistency": "double",
    "time_to_first_byte_ms": "bigint",
}
DOMAIN_CONTROLS = {"site_scale": "double", "authority_proxy": "double"}


def attach_page_controls(frame: DataFrame, onpage: DataFrame | None) -> DataFrame:
    """The three page controls in one left join; typed nulls for what is absent."""
    present = [c for c in PAGE_CONTROLS if onpage is not None and c in onpage.columns]
    if present:
        frame = frame.join(onpage.select(*PAGE_KEY, *present), PAGE_KEY, "left")
    return with_null_columns(frame, PAGE_CONTROLS)


def attach_domain_controls(frame: DataFrame, domain_feats: DataFrame | None) -> DataFrame:
    present = [c for c in DOMAIN_CONTROLS if domain_feats is not None and c in domain_feats.columns]
    if present:
        # Controls depend on (run, domain) alone, so any row of the pair holds them.
        lookup = domain_feats.groupBy("run_id", F.col("domain").alias("__domain")).agg(
            *[F.max(c).alias(c) for c in present]
        )
        frame = join_measured(frame.withColumn("__domain", hostname("url")), lookup, ["run_id", "__domain"], "left").drop("__domain")
    return with_null_columns(frame, DOMAIN_CONTROLS)


def restore_domain_controls(frame: DataFrame, domain_feats: DataFrame) -> DataFrame:
    """Fill missing controls of an older mart from the domain features."""
    kept = frame.select("*", *[F.col(c).alias(f"__old_{c}") for c in DOMAIN_CONTROLS if c in frame.columns])
    fresh = attach_domain_controls(kept.drop(*DOMAIN_CONTROLS), domain_feats)
    values = {
        c: F.coalesce(F.col(f"__old_{c}"), F.col(c)) if f"__old_{c}" in fresh.columns else F.col(c)
        for c in DOMAIN_CONTROLS
    }
    return fresh.withColumns(values).drop(*[f"__old_{c}" for c in DOMAIN_CONTROLS])


def analysis_mart(
    serp: DataFrame,
    page_feats: DataFrame,
    onpage: DataFrame | None = None,
    domain_feats: DataFrame | None = None,
    max_group: int | None = None,
) -> DataFrame:
    """Ranked rows with page scores, controls and within-keyword ranks of the scores.

    Ranked lists are cut at the depth, so keyword groups are bounded and a plain
    window ranks them (``max_group`` None); pass a size for uncut lists.
    """
    scored = page_feats.select(*PAGE_KEY, "page_id", "response_id", "page_text_length", *SCORE_COLUMNS)
    frame = serp.drop("schema_version").join(scored, PAGE_KEY, "left")
    frame = attach_domain_controls(attach_page_controls(frame, onpage), domain_feats)
    ranked = ordinal_ranks(
        frame, {s: f"{s}_normalized_score" for s in S.SCORERS}, ["run_id", "target_keyword_id"], group_limit=max_group
    )
    return ranked.withColumn("schema_version", F.lit(S.ANALYSIS_VERSION))


def with_source_columns(analysis: DataFrame, source: DataFrame) -> DataFrame:
    """Analysis mart plus the signal columns of a backlink or on-page table."""
    extra = [c for c in source.columns if c not in analysis.columns and c not in PAGE_KEY and not c.endswith("response_id")]
    return analysis.join(source.select(*PAGE_KEY, *extra), PAGE_KEY, "left").withColumn(
        "schema_version", F.lit(S.FEATURE_VERSION)
    )


def with_text_metrics(analysis: DataFrame, metrics: DataFrame | None) -> DataFrame:
    wanted = {f.name: f.dataType for f in S.CURATED["page_metrics"].fields if f.name.startswith("textrazor_")}
    if metrics is None:
        return with_null_columns(analysis, wanted)
    return analysis.join(
        metrics.select(*PAGE_KEY, "page_metrics_row_id", *[c for c in wanted if c in metrics.columns]), PAGE_KEY, "left"
    )


def importance_panel(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join marts on the page key; the ranked item joins the key where both have it.

    A mart must have one row per key, so that no row of ``base`` is multiplied; a second
    row of a key stops the job with its key.
    """
    out = base
    for other in others:
        keys = [*PAGE_KEY, *(["serp_item_id"] if "serp_item_id" in out.columns and "serp_item_id" in other.columns else [])]
        added = [c for c in other.columns if c not in out.columns]
        single = other.groupBy(*keys).agg(*[F.first(c).alias(c) for c in added], F.count(F.lit(1)).alias("__rows"))
        message = F.concat(F.lit("several mart rows for "), F.concat_ws("|", *keys))
        # Checked in the same aggregate that the join uses; the filter keeps the check alive.
        single = single.where(F.when(F.col("__rows") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("__rows")
        out = out.join(single, keys, "left")
    return out


# --- entity presence --------------------------------------------------------


def entity_occurrences(entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mentions, means, distinct texts and types per entity and page in one shuffle."""
    return entities.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entity_mention_count"),
        F.avg("confidence").alias("entity_confidence_mean"),
        F.avg("relevance").alias("entity_relevance_mean"),
        F.array_sort(F.collect_set("matched_text")).alias("matched_texts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.coalesce("types", F.array()), lambda t: t.isNotNull()))))).alias(
            "entity_types"
        ),
    )


def best_ranks(serp_items: DataFrame, keys: Sequence[str] = PAGE_KEY) -> DataFrame:
    return serp_items.groupBy(*keys).agg(F.min("serp_rank").alias("serp_rank"))


def entity_signals(entities: DataFrame, metrics: DataFrame, serp_items: DataFrame) -> DataFrame:
    """One row per entity and usable page of a keyword where the entity was seen.

    The result itself is the expansion (entity x page of the keyword), so its size
    is the size of the answer.  The expansion joins on the keyword; adaptive
    execution splits a keyword that has very many pages.
    """
    keys = [*KEYWORD_KEY, "canonical_url_hash", "url", "entity_id"]
    seen = entity_occurrences(entities, keys)
    candidates = entities.select(*KEYWORD_KEY, "entity_id").distinct()
    usable = metrics.select(*KEYWORD_KEY, "canonical_url_hash", "url").join(best_ranks(serp_items), PAGE_KEY, "inner")
    empty = F.expr("cast(array() as array<string>)")
    return (
        candidates.join(usable, KEYWORD_KEY, "inner")
        .join(seen, keys, "left")
        .select(
            *KEYWORD_KEY,
            "canonical_url_hash",
            "url",
            "serp_rank",
            "entity_id",
            F.coalesce("matched_texts", empty).alias("matched_texts"),
            F.coalesce("entity_types", empty).alias("entity_types"),
            F.col("entity_mention_count").isNotNull().cast("bigint").alias("entity_present"),
            F.coalesce("entity_mention_count", F.lit(0)).cast("bigint").alias("entity_mention_count"),
            "entity_confidence_mean",
            "entity_relevance_mean",
            F.lit(S.FEATURE_VERSION).alias("schema_version"),
        )
    )


def feature_marts(
    curated: dict[str, DataFrame], materialise: Callable[[DataFrame], DataFrame] = cut_lineage
) -> dict[str, DataFrame]:
    """All marts of a run from its curated tables.

    Domain features and the analysis mart feed several others, so they are written
    once; pass a function that writes a table to keep them.
    """
    onpage = curated["onpage_signals"]
    pages_scored = page_features(curated["pages"], curated["similarity_scores"])
    domains = materialise(domain_features(curated["serp_items"], onpage))
    serp = panel_rows(keyword_serp(curated["keywords"], curated["serp_items"]), pages_scored, domains)
    analysis = materialise(analysis_mart(serp, pages_scored, onpage, domains))
    return {
        "keyword_serp": serp,
        "page_features": pages_scored,
        "passage_features": passage_features(curated["passages"]),
        "domain_features": domains,
        "analysis_mart": analysis,
        "backlinks_analysis": with_source_columns(analysis, curated["backlinks"]),
        "onpage_features": with_source_columns(analysis, onpage),
        "page_metrics": curated["page_metrics"],
        "entity_signals": entity_signals(curated["entities"], curated["page_metrics"], curated["serp_items"]),
    }
