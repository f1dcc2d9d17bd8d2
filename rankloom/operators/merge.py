"""Keys, upserts, run combination and missing work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import schemas as S
from rankloom.functions import variant as V
from rankloom.functions.text import canonical_url, fold_case, stripped
from rankloom.operators.curate import record_url
from rankloom.operators.filters import owned_rows
from rankloom.operators.groups import first_per_key
from rankloom.operators.quality import ContractError

RECORD_KEY = ("endpoint", "record_key", "record_scope")


# --- records and their identity --------------------------------------------


def build_records(
    frame: DataFrame, run_id: str, endpoint: str, provider: str, body: str = "body_json", metadata: str = "metadata_json"
) -> DataFrame:
    """Raw records from ``(target_keyword, timestamp, body, metadata)`` rows.

    Ids follow from content alone, so building a record again gives the same row.
    """
    text = F.col(body)
    digest = F.sha2(text, 256)
    parsed = F.try_parse_json(text)
    task_id = F.get(V.elements(parsed, "$.tasks"), F.lit(0))
    return frame.select(
        F.lit(run_id).alias("run_id"),
        F.left(
            F.sha2(F.concat_ws("|", F.lit(run_id), F.lit(endpoint), F.coalesce("target_keyword", F.lit("")), digest), 256),
            F.lit(32),
        ).alias("response_id"),
        F.lit(endpoint).alias("endpoint"),
        F.lit(provider).alias("provider"),
        "target_keyword",
        F.coalesce(V.text(task_id, "$.id"), V.strict_integer(task_id, "$.id").cast("string")).alias("task_id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        F.to_json(F.parse_json(F.col(metadata))).alias("request_metadata_json"),
        F.lit("application/json").alias("content_type"),
        F.lit(200).cast("bigint").alias("status"),
        F.encode(text, "UTF-8").alias("response_body_bytes"),
        digest.alias("sha256"),
        F.lit(S.RAW_VERSION).alias("schema_version"),
    )


def with_record_key(raw: DataFrame) -> DataFrame:
    """``record_key`` and ``record_scope``: what makes two records the same request.

    Expansion and ranking requests are one per keyword, embeddings are keyed by
    their input, everything else by canonical URL (and variant for backlinks), and
    a record without any URL by its own id.
    """
    meta = F.try_parse_json(F.coalesce("request_metadata_json", F.lit("{}")))
    url = record_url(V.parse_body("response_body_bytes"), meta)
    embedding = F.to_json(
        F.struct(
            *[V.text(meta, f"$.{k}").alias(k) for k in ("role", "input_sha256", "model")],
            V.strict_integer(meta, "$.output_dimensionality").alias("dimensions"),
            F.coalesce(canonical_url(V.text(meta, "$.url")), F.lit("")).alias("url"),
        )
    )
    variant = F.when(
        F.col("endpoint").startswith("backlinks"),
        F.concat(F.lit("|"), F.coalesce(V.first_text([V.text(meta, "$.variant")]), F.lit("summary"))),
    ).otherwise(F.lit(""))
    scope = (
        F.when(F.col("endpoint").isin("keyword_expansion", "serp"), F.lit(""))
        .when(F.col("endpoint") == "gemini_embeddings", embedding)
        .when(url.isNotNull(), F.concat(canonical_url(url), variant))
        .otherwise(F.col("response_id"))
    )
    return raw.withColumns(
        {"record_key": stripped(fold_case(F.coalesce("target_keyword", F.lit("")))), "record_scope": scope}
    )


# --- upserts ----------------------------------------------------------------


def upsert(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    new_wins: bool = True,
    last_duplicate: bool | None = None,
) -> DataFrame:
    """One row per key from both sides.

    ``new_wins`` picks the side; within a side the last row in ``order`` wins when
    the new side does, else the first one (override with ``last_duplicate``).  The
    losing rows are dropped before the shuffle.
    """
    last = new_wins if last_duplicate is None else last_duplicate
    both = existing.withColumn("__new", F.lit(False)).unionByName(
        new.withColumn("__new", F.lit(True)), allowMissingColumns=True
    )
    side = F.col("__new").desc() if new_wins else F.col("__new").asc()
    rows = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return first_per_key(both, keys, [side, *rows]).drop("__new")


def merge_replayed(
    stored: DataFrame,
    rebuilt: DataFrame,
    keys: Sequence[str],
    body: str = "response_body_bytes",
    keep_expansion: bool = True,
) -> DataFrame:
    """Stored rows stay unless the rebuilt body differs; unseen keys are added.

    Both sides have unique keys.  With ``keep_expansion`` rebuilt keyword lists
    are ignored.
    """
    if keep_expansion and "endpoint" in rebuilt.columns:
        rebuilt = rebuilt.where(F.col("endpoint") != "keyword_expansion")
    columns = stored.columns
    left = stored.select(*keys, F.struct(*columns).alias("__old"))
    right = rebuilt.select(*keys, F.struct(*[F.col(c) for c in columns]).alias("__new"))
    joined = left.join(right, list(keys), "full_outer")
    keep_old = F.col("__new").isNull() | F.coalesce(F.col(f"__old.{body}").eqNullSafe(F.col(f"__new.{body}")), F.lit(False))
    chosen = F.when(F.col("__old").isNotNull() & keep_old, F.col("__old")).otherwise(F.col("__new"))
    return joined.select(chosen.alias("r")).select("r.*")


def merge_scores(base: DataFrame, later: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Later scores override only what they provide; URLs from both sides stay."""
    missing = [c for c in scores if c not in base.columns]
    left = base.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in scores if c not in missing])
    right = later.select(*keys, *[F.col(c).alias(f"__l_{c}") for c in scores if c in later.columns])
    joined = left.join(right, list(keys), "full_outer")

    def pick(c):
        found = [F.col(f"__{side}_{c}") for side in ("l", "b") if f"__{side}_{c}" in joined.columns]
        return (F.coalesce(*found) if found else F.lit(None).cast("double")).alias(c)

    return joined.select(*keys, *[pick(c) for c in scores])


def enrich_scores(scores: DataFrame, metrics: DataFrame, keys: Sequence[str] = ("target_keyword", "url")) -> DataFrame:
    """Add the entity confidence and relevance of the page, rounded to 6 digits."""
    wanted = ("textrazor_entity_confidence_score", "textrazor_entity_relevance_score")
    return scores.join(
        metrics.select(*keys, *[F.round(c, 6).alias(c) for c in wanted]), list(keys), "left"
    )


def invalidate(dependents: DataFrame, refreshed: DataFrame, keys: Sequence[str], recomputed: DataFrame | None = None) -> DataFrame:
    """Drop dependents of refreshed keys and add their recomputed rows."""
    kept = dependents.join(refreshed.select(*keys).distinct(), list(keys), "left_anti")
    if recomputed is None:
        return kept
    fresh = recomputed.join(refreshed.select(*keys).distinct(), list(keys), "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


# --- combining runs ---------------------------------------------------------


def union_runs(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union by name in listed order with ``source_run`` and ``run_order``; types widen."""
    out = None
    for i, (name, frame) in enumerate(frames):
        tagged = frame.withColumns({"source_run": F.lit(name), "run_order": F.lit(i).cast("bigint")})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def keyword_owners(combined: DataFrame, key: Sequence[str] = ("target_keyword_id",)) -> DataFrame:
    """The last listed run that has a keyword owns it."""
    return combined.groupBy(*key).agg(F.max("run_order").alias("run_order"), F.max_by("source_run", "run_order").alias("owner"))


def combine_runs(combined: DataFrame, key: Sequence[str] = ("target_keyword_id",)) -> DataFrame:
    return owned_rows(combined, keyword_owners(combined, key), [*key, "run_order"])


def keyword_overlaps(combined: DataFrame, key: Sequence[str] = ("target_keyword_id",)) -> DataFrame:
    """Keywords of several runs: the selected run and the dropped ones in order.

    Reduced to one row per (keyword, run) first; the list is as long as the number
    of runs, which the caller lists by name.
    """
    per_run = combined.groupBy(*key, "source_run").agg(F.min("run_order").alias("run_order"))
    runs = F.array_sort(F.collect_list(F.struct("run_order", "source_run")))
    return (
        per_run.groupBy(*key)
        .agg(runs.alias("runs"))
        .where(F.size("runs") > 1)
        .select(
            *key,
            F.element_at("runs", -1)["source_run"].alias("selected_run"),
            F.transform(F.slice("runs", F.lit(1), F.size("runs") - 1), lambda r: r["source_run"]).alias("dropped_runs"),
        )
    )


def config_mismatches(configs: DataFrame, fields: Sequence[str], run: str = "source_run") -> DataFrame:
    """Settings that differ between runs, one row per run in.

    ``field``, ``distinct_values``, ``run_count`` and ``run_values``: (run, value as JSON) of
    every run by name; as long as the list of runs.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("value")), {"ignoreNullFields": "false"}).alias("value")) for f in fields])
    long = configs.select(run, F.inline(cells))
    return (
        long.groupBy("field")
        .agg(F.count_distinct("value").alias("distinct_values"), F.count(F.lit(1)).alias("run_count"), F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), "value"))).alias("run_values"))
        .where("distinct_values > 1")
    )


def require_one_version(frame: DataFrame, column: str = "schema_version") -> DataFrame:
    """Raise if the rows carry more than one schema version."""
    found = frame.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if found["lo"] != found["hi"]:
        raise ContractError(f"schema versions differ: {found['lo']} and {found['hi']}")
    return frame


# --- missing work -----------------------------------------------------------


def missing_urls(ranked: DataFrame, stored: DataFrame, order: Sequence[Column], url: str = "url") -> DataFrame:
    """Ranked URLs without a stored response, by canonical identity, first spelling kept."""
    keyed = ranked.withColumn("canonical_url", canonical_url(url))
    wanted = first_per_key(keyed, ["canonical_url"], order)
    have = stored.select(canonical_url(url).alias("canonical_url")).distinct()
    return wanted.join(have, "canonical_url", "left_anti")


def score_completeness(ranked: DataFrame, scores: DataFrame, scorers: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per keyword: do all ranked URLs have all scores?"""
    full = F.lit(True)
    for c in scorers:
        full = full & F.col(c).isNotNull()
    checked = scores.groupBy(*keys).agg(F.bool_or(full).alias("__full"))
    joined = ranked.join(checked, list(keys), "left").withColumn("__full", F.coalesce("__full", F.lit(False)))
    return joined.groupBy(keys[0]).agg(
        F.count(F.lit(1)).alias("url_count"),
        F.count_if("__full").alias("scored_count"),
        F.bool_and("__full").alias("is_complete"),
    )


def missing_variants(urls: DataFrame, usable: DataFrame, variants: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(URL, variant) pairs without a usable response; the variant list is a literal."""
    wanted = urls.select(*keys).distinct().withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    return wanted.join(usable.select(*keys, "variant").distinct(), [*keys, "variant"], "left_anti")


def missing_pages(pages: DataFrame, done: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First non-blank page per (keyword, URL) that has no stored analysis yet."""
    filled = pages.where(stripped("text") != "").withColumns(
        {"__k": stripped(fold_case("target_keyword")), "__u": stripped("url")}
    ).where("__k != '' and __u != ''")
    first = first_per_key(filled, ["__k", "__u"], order)
    known = done.select(stripped(fold_case("target_keyword")).alias("__k"), canonical_url(stripped("url")).alias("__c")).distinct()
    return (
        first.withColumn("__c", canonical_url("__u")).join(known, ["__k", "__c"], "left_anti").drop("__k", "__u", "__c")
    )


def changed_scope(keywords: DataFrame, statuses: DataFrame, key: str = "target_keyword") -> DataFrame:
    """Keywords to fetch again: scope changed, never stored, or nothing usable stored."""
    joined = keywords.withColumn("__k", fold_case(key)).join(
        statuses.select(fold_case("keyword_key").alias("__k"), "usable", F.col("scope").alias("__stored")), "__k", "left"
    )
    reason = (
        F.when(F.col("usable").isNull(), "not stored")
        .when(~F.col("__stored").eqNullSafe(F.col("scope")), "scope changed")
        .when(~F.col("usable"), "not usable")
    )
    return joined.withColumn("reason", reason).where("reason is not null").drop("__k", "usable", "__stored")
