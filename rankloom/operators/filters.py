"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import blocking_host, host_suffixes

# The confirmatory depths.
RANK_DEPTHS = {"top_20": 20, "top_10": 10, "top_5": 5, "top_3": 3}
REQUIRED_CONTROLS = ("site_scale", "authority_proxy")


def within_depth(panel: DataFrame, max_rank: int, rank: str = "serp_rank") -> DataFrame:
    return panel.where(F.col(rank).between(1, max_rank))


def expand_depths(
    panel: DataFrame, depths: Mapping[str, int] = RANK_DEPTHS, rank: str = "serp_rank"
) -> DataFrame:
    """One copy of a row per depth that admits it, so one job serves all depths.

    The depth list is a literal of the plan (a handful of entries), exploded row by
    row; nothing is joined or shuffled.
    """
    entries = F.array(
        *[F.struct(F.lit(k).alias("rank_depth"), F.lit(v).cast("bigint").alias("max_rank")) for k, v in depths.items()]
    )
    admitted = F.filter(entries, lambda e: (F.col(rank) >= 1) & (F.col(rank) <= e["max_rank"]))
    return panel.withColumn("__d", F.explode(admitted)).select(
        F.col("__d.rank_depth").alias("rank_depth"), F.col("__d.max_rank").alias("max_rank"), *panel.columns
    )


def drop_blocked_domains(frame: DataFrame, blocklist: DataFrame, url: str = "url", entry: str = "domain") -> DataFrame:
    """Drop rows whose host is an entry or a subdomain of one; null URLs drop out.

    Only the distinct hosts are expanded into suffixes and matched; the rows then
    meet the blocked hosts in one equi anti join.
    """
    hosts = frame.select(blocking_host(url).alias("__host")).where("__host is not null").distinct()
    entries = blocklist.select(F.col(entry).alias("__suffix")).where("__suffix is not null").distinct()
    blocked = (
        hosts.withColumn("__suffix", F.explode(host_suffixes("__host")))
        .join(entries, "__suffix", "left_semi")
        .select("__host")
        .distinct()
    )
    keyed = frame.where(F.col(url).isNotNull()).withColumn("__host", blocking_host(url))
    return keyed.join(blocked, "__host", "left_anti").drop("__host")


def unblocked_scores(scored: DataFrame, serp: DataFrame, blocklist: DataFrame, url: str = "url", keys: Sequence[str] = ("target_keyword",)) -> DataFrame:
    """Scored pages whose URL stands in an unblocked ranked row of the same keyword.

    Only the distinct (keyword, URL) pairs of the ranked rows travel to the scores.
    """
    open_urls = drop_blocked_domains(serp.select(*keys, url).distinct(), blocklist, url)
    return scored.join(open_urls, [*keys, url], "left_semi")


def complete_controls(frame: DataFrame, controls: Sequence[str] = REQUIRED_CONTROLS) -> DataFrame:
    """Keep rows with a value in every control that exists as a column (NaN is a value)."""
    for column in controls:
        if column in frame.columns:
            frame = frame.where(F.col(column).isNotNull())
    return frame


def keyword_view(frame: DataFrame, keyword: str, column: str = "target_keyword", prefix: str = "textrazor_") -> DataFrame:
    """All rows of one keyword; analysis columns by name, then the text metrics."""
    metric = [c for c in frame.columns if c == "page_metrics_row_id" or c.startswith(prefix)]
    plain = sorted(c for c in frame.columns if c not in metric)
    return frame.where(F.col(column) == keyword).select(*plain, *metric)


def owned_rows(frame: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.join(owners.select(*keys).distinct(), list(keys), "left_semi")


def with_null_columns(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the missing ones of ``{name: type}`` as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in frame.columns}
    return frame.withColumns(missing) if missing else frame
