"""All statistics of all rank depths and signals from one panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import rank_outcome
from rankloom.operators.filters import RANK_DEPTHS, complete_controls, expand_depths
from rankloom.operators.groups import first_per_key, join_null_safe
from rankloom.session import cut_lineage
from rankloom.stats.moments import element, melt_signals
from rankloom.stats.regression import regression_table
from rankloom.stats.spearman import inference_mode, is_actionable, list_correlations, summarize_correlations

MODEL = ["rank_depth", "signal"]

# Signal families and where their columns live.
SIGNAL_KINDS = ("similarity", "onpage", "backlinks", "textrazor")


def prepare_panel(analysis: DataFrame, max_rank: int = 20) -> DataFrame:
    """Ranked rows within depth, one per (keyword, page): best rank, then item id."""
    rows = analysis.where(F.col("serp_rank").between(1, max_rank))
    return first_per_key(
        rows, ["run_id", "target_keyword_id", "canonical_url_hash"], [F.col("serp_rank").asc(), F.col("serp_item_id").asc()]
    )


def long_panel(
    panel: DataFrame,
    signals: Sequence[str],
    controls: Sequence[str],
    key: str = "target_keyword_id",
    depths: Mapping[str, int] = RANK_DEPTHS,
    rank: str = "serp_rank",
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per (depth, signal, keyword, page) with outcome and controls."""
    rows = expand_depths(panel.withColumn("outcome", rank_outcome(F.col(rank))), depths, rank)
    return melt_signals(complete_controls(rows, controls), signals, ["rank_depth", key, rank, "outcome", *controls, *extra])


def association_table(
    panel: DataFrame,
    signals: Sequence[str],
    controls: Sequence[str],
    key: str = "target_keyword_id",
    depths: Mapping[str, int] = RANK_DEPTHS,
    rank: str = "serp_rank",
) -> DataFrame:
    """Correlation summary and regression of every (depth, signal) in one table.

    Depths whose keywords have no rank spread at all are reported with mode
    ``hard_fail`` and no statistics.
    """
    long = cut_lineage(long_panel(panel, signals, controls, key, depths, rank))
    spread = long.groupBy("rank_depth", key).agg((F.min(rank) < F.max(rank)).alias("v")).groupBy("rank_depth").agg(
        F.bool_and("v").alias("rank_varies")
    )
    usable = join_null_safe(long, spread.where("rank_varies"), ["rank_depth"], "left_semi")
    lists = complete_controls(panel.where(F.col(rank).between(1, max(depths.values()))), controls)
    every = list_correlations(lists, [key], signals, dict(depths), rank)
    tests = cut_lineage(join_null_safe(every, F.broadcast(spread.where("rank_varies")), ["rank_depth"], "left_semi").select(*MODEL, "rho"))
    summary = summarize_correlations(tests, MODEL).drop("status")
    fits = regression_table(usable, MODEL, key, ["value", *controls])
    table = join_null_safe(fits, summary, MODEL, "left").withColumns(
        {
            "coefficient": element(F.col("beta"), 0),
            "standard_error": element(F.col("standard_errors"), 0),
            "p_value": element(F.col("p_values"), 0),
            "low": element(F.col("ci_low"), 0),
            "high": element(F.col("ci_high"), 0),
        }
    )
    stated = table.withColumns(
        {
            "mode": inference_mode(F.coalesce("keyword_count", F.lit(0))),
            "actionable": is_actionable(F.col("median_rho"), F.col("fraction_same_sign"), F.col("low"), F.col("high")),
        }
    )
    failed = (
        long.join(spread.where("not rank_varies"), "rank_depth", "left_semi")
        .groupBy(*MODEL)
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("groups"))
        .withColumns({"status": F.lit("skipped"), "reason": F.lit("rank_variance"), "mode": F.lit("hard_fail"), "actionable": F.lit(False)})
    )
    return stated.unionByName(failed, allowMissingColumns=True)
