"""Backlink and on-page responses to one row per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import schemas as S
from rankloom.functions import variant as V
from rankloom.functions.text import canonical_url, stable_id
from rankloom.operators.curate import _context, _shape, _url_hash, _version, made_once, open_bodies, record_url
from rankloom.operators.drift import (
    backlinks_usable,
    legacy_backlinks,
    onpage_item,
    onpage_usable,
    single_result,
    successful_empty,
)
from rankloom.operators.groups import first_per_key

BACKLINK_ENDPOINTS = ("backlinks", "backlinks_summary", "backlinks_dofollow_summary")


def backlink_variant(endpoint: Column, meta: Column) -> Column:
    named = V.first_text([V.text(meta, "$.variant"), V.text(meta, "$.backlinks_query")])
    return F.coalesce(named, F.when(endpoint == "backlinks_dofollow_summary", "dofollow").otherwise("summary"))


def backlink_responses(raw: DataFrame) -> DataFrame:
    """Responses with variant, URL and the result object (zeros for a successful empty)."""
    body, meta = F.col("body"), F.col("meta")
    return open_bodies(raw, *BACKLINK_ENDPOINTS).select(
        "run_id",
        "target_keyword",
        "response_id",
        "timestamp",
        made_once(
            backlink_variant(F.col("endpoint"), meta).alias("variant"),
            record_url(body, meta).alias("url"),
            F.when(successful_empty(body), F.parse_json(F.lit('{"backlinks":0,"referring_domains":0}')))
            .otherwise(single_result(body))
            .alias("result"),
        ),
        "body",
    ).where("url is not null")


def _metric_problems(result: Column, required: tuple[str, ...], optional: list[str]) -> Column:
    """Names of metrics that are missing although required, or not numeric."""
    checks = [F.when(~V.is_number(V.at(result, f"$.{c}")), F.lit(c)) for c in required]
    checks += [
        F.when(~V.is_missing(V.at(result, f"$.{c}")) & ~V.is_number(V.at(result, f"$.{c}")), F.lit(c)) for c in optional
    ]
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def backlink_problems(raw: DataFrame) -> DataFrame:
    """``(response_id, variant, column_name)`` for results that cannot become a row."""
    rows = backlink_responses(raw).where(~legacy_backlinks(F.col("result")) | F.col("result").isNull())
    required = F.when(
        F.col("variant") == "dofollow", _metric_problems(F.col("result"), ("backlinks",), ["referring_domains"])
    ).otherwise(_metric_problems(F.col("result"), ("backlinks", "referring_domains"), S.BACKLINK_OPTIONAL))
    return rows.select("response_id", "variant", F.explode(required).alias("column_name"))


def backlinks(raw: DataFrame) -> DataFrame:
    """One row per (keyword, URL) from the latest summary and dofollow responses.

    Both variants are reduced in one shuffle on (run, keyword, URL); the result
    objects travel as JSON text because a Variant cannot be compared or grouped.
    URLs without a summary and rows with unusable required metrics are left out;
    :func:`backlink_problems` lists the latter.
    """
    order = F.struct(F.coalesce("timestamp", F.lit("")), "response_id")
    payload = F.struct("response_id", F.to_json("result").alias("result"))

    def latest(kind: Column) -> Column:
        return F.max_by(F.when(kind, payload), F.when(kind, order))

    dofollow = F.col("variant") == "dofollow"
    pairs = (
        backlink_responses(raw)
        .where(F.col("result").isNotNull() & (F.col("variant") != "detail"))
        .groupBy("run_id", "target_keyword", "url")
        .agg(latest(~dofollow).alias("s"), latest(dofollow).alias("d"))
        .where("s is not null")
        .select("*", made_once(F.try_parse_json("s.result").alias("sr"), F.try_parse_json("d.result").alias("dr")))
    )
    s, d = F.col("sr"), F.col("dr")
    legacy = legacy_backlinks(s)
    modern = lambda c: F.when(~legacy, c)
    rows = pairs.where(legacy | (F.size(_metric_problems(s, ("backlinks", "referring_domains"), [])) == 0))
    return _shape(
        rows.select(
            *_context(),
            F.col("s.response_id").alias("response_id"),
            F.col("s.response_id").alias("summary_response_id"),
            F.col("d.response_id").alias("dofollow_summary_response_id"),
            stable_id("run_id", "target_keyword", "url").alias("backlink_id"),
            _url_hash(),
            "url",
            F.when(legacy, F.coalesce(V.integer(s, "$.total_count"), V.integer(s, "$.items_count")))
            .otherwise(V.integer(s, "$.backlinks"))
            .alias("backlinks_count"),
            modern(V.integer(s, "$.referring_domains")).alias("referring_domains_count"),
            modern(V.integer(d, "$.backlinks")).alias("dofollow_backlinks_count"),
            modern(V.integer(d, "$.referring_domains")).alias("dofollow_referring_domains_count"),
            V.integer(s, "$.info.target_spam_score").alias("target_spam_score"),
            *[modern(V.integer(s, f"$.{c}")).alias(c) for c in S.BACKLINK_OPTIONAL],
            *[modern(V.text(s, f"$.{c}")).alias(c) for c in ("first_seen", "lost_date")],
            *[modern(V.sorted_json(s, f"$.{c}")).alias(f"{c}_json") for c in S.BACKLINK_DISTRIBUTIONS],
            (F.col("d").isNotNull() & ~legacy).alias("backlinks_metrics_complete"),
            _version(),
        ),
        "backlinks",
    )


def onpage_columns(item: Column) -> dict[str, Column]:
    """All signal columns of one on-page item."""
    nested = V.at(item, "$.meta.content")
    filled = V.is_object(nested) & (F.size(V.keys(item, "$.meta.content")) > 0)

    def content(name):
        # Content sits under meta; flat only in old rows.
        return F.when(filled, V.number(item, f"$.meta.content.{name}")).otherwise(V.number(item, f"$.content.{name}"))

    def check(name):
        own = V.boolean(item, f"$.checks.{name}")
        return F.coalesce(own, V.boolean(item, f"$.{name}")) if name in S.ITEM_LEVEL_FLAGS else own

    def resource_length(name):
        value = V.at(item, f"$.resource_errors.{name}")
        return F.when(F.is_variant_null(value), F.lit(0).cast("bigint")).otherwise(
            V.array_length(item, f"$.resource_errors.{name}")
        )

    out = {"onpage_score": V.number(item, "$.onpage_score")}
    out.update({name: check(name) for name in S.CHECK_FLAGS})
    out.update({name: content(name) for name in S.CONTENT_NUMBERS})
    out.update({name: V.integer(item, f"$.meta.{name}") for name in S.META_INTEGERS})
    out["follow"] = V.boolean(item, "$.meta.follow")
    out["duplicate_meta_tags_count"] = V.array_length(item, "$.meta.duplicate_meta_tags")
    out.update({f"h{i}_count": V.array_length(item, f"$.meta.htags.h{i}") for i in (1, 2, 3)})
    out["has_og_tags"] = V.has_key_prefix(item, "$.meta.social_media_tags", "og:")
    out["has_twitter_tags"] = V.has_key_prefix(item, "$.meta.social_media_tags", "twitter:")
    out.update({name: V.integer(item, f"$.page_timing.{key}") for name, key in S.TIMING_INTEGERS.items()})
    out.update({name: V.number(item, f"$.page_timing.{key}") for name, key in S.TIMING_NUMBERS.items()})
    out["cumulative_layout_shift"] = F.coalesce(
        *[V.number(item, f"{place}.cumulative_layout_shift") for place in ("$.meta", "$.page_timing", "$")]
    )
    out.update({name: V.integer(item, f"$.{name}") for name in S.ITEM_INTEGERS})
    out.update({f"micromarkup_{k}_count": V.integer(item, f"$.micromarkup.{k}_count") for k in ("items", "errors", "warnings")})
    marked, faulty = check("has_micromarkup"), check("has_micromarkup_errors")
    out["has_valid_structured_data"] = F.when(marked, F.coalesce(~faulty, F.lit(False))).when(~marked, F.lit(False))
    out["cache_control_cachable"] = V.boolean(item, "$.cache_control.cachable")
    out["cache_control_ttl"] = V.integer(item, "$.cache_control.ttl")
    out.update({f"resource_{k}_count": resource_length(k) for k in ("errors", "warnings")})
    out.update({name: V.boolean(item, f"$.{name}") for name in S.ITEM_FLAGS})
    return out


def onpage_signals(raw: DataFrame) -> DataFrame:
    """Latest usable on-page response per (keyword, canonical URL)."""
    usable = (
        open_bodies(raw, "onpage_instant_pages")
        .where(onpage_usable(F.col("body")))
        .select("run_id", "target_keyword", "response_id", "timestamp", record_url(F.col("body"), F.col("meta")).alias("url"), "response_body_bytes")
        .where("url is not null")
        .withColumn("__key", canonical_url("url"))
    )
    latest = first_per_key(
        usable,
        ["run_id", "target_keyword", "__key"],
        [F.coalesce("timestamp", F.lit("")).desc(), F.col("response_id").desc()],
    )
    items = latest.withColumn("item", onpage_item(V.parse_body("response_body_bytes")))
    return _shape(
        items.select(
            *_context(),
            "response_id",
            stable_id("run_id", "target_keyword", "url").alias("onpage_signal_id"),
            _url_hash(),
            "url",
            _version(),
            *[c.alias(n) for n, c in onpage_columns(F.col("item")).items()],
        ),
        "onpage_signals",
    )


def latest_usable_backlinks(raw: DataFrame) -> DataFrame:
    """Latest usable stored response per (keyword, canonical URL, variant)."""
    usable = backlink_responses(raw).where(backlinks_usable(F.col("body"), F.col("variant")))
    keyed = usable.select("run_id", "target_keyword", canonical_url("url").alias("canonical_url"), "variant", "response_id", "timestamp", "url")
    return first_per_key(
        keyed,
        ["run_id", "target_keyword", "canonical_url", "variant"],
        [F.coalesce("timestamp", F.lit("")).desc(), F.col("response_id").desc()],
    )
