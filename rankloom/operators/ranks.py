"""Ranks, percentiles and z-scores within a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numeric import zscore
from rankloom.operators.groups import (
    GROUP_ROWS_PER_TASK,
    attach_group_stats,
    group_row_number,
    group_running,
    join_null_safe,
)


def _moments(scores: Sequence[str], over: Callable[[Column], Column] = lambda aggregate: aggregate) -> list[Column]:
    """Count, mean and deviation of each score; ``over`` makes the aggregates windows."""
    out = []
    for s in scores:
        x = F.col(s).cast("double")
        n, least, most = over(F.count(x)), over(F.min(x)), over(F.max(x))
        out += [
            n.alias(f"__n_{s}"),
            over(F.avg(x)).alias(f"__mean_{s}"),
            # A constant group has deviation 0; rounding in the last digits must not hide it.
            F.when(most - least <= 1e-13 * F.greatest(F.abs(most), F.abs(least)), F.when(n > 1, F.lit(0.0)))
            .otherwise(over(F.stddev_samp(x)))
            .alias(f"__sd_{s}"),
        ]
    return out


def ordinal_ranks(
    frame: DataFrame,
    scores: Mapping[str, str],
    keys: Sequence[str] = ("run_id", "target_keyword_id"),
    tie_order: Sequence[str] = ("serp_rank", "canonical_url_hash"),
    group_limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """``<name>_rank``, ``<name>_pct`` and ``<name>_z`` for each ``{name: score}``.

    Best score first, ties in the given order, a null score gets no rank.  The
    percentile is ``(rank - 1) / (n - 1)`` over the non-null scores and 0 for a
    group with a single score; z is null where the deviation is 0 or undefined.
    """
    base = frame.columns
    if group_limit is None and keys:
        # Bounded groups: the moments use the windows that rank, so rows are moved once.
        whole = Window.partitionBy(*keys)
        out = frame.select("*", *_moments(list(scores.values()), lambda aggregate: aggregate.over(whole)))
    else:
        out = attach_group_stats(frame, keys, _moments(list(scores.values())))
    for name, score in scores.items():
        order = [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in tie_order]]
        out = group_row_number(out, keys, order, "__rn", group_limit)
        n = F.col(f"__n_{score}")
        rank = F.when(F.col(score).isNotNull(), F.col("__rn"))
        out = out.withColumns(
            {
                f"{name}_rank": rank,
                f"{name}_pct": F.when(n == 1, F.lit(0.0)).otherwise((rank - 1) / F.nullif(n - 1, F.lit(0))),
                f"{name}_z": zscore(F.col(score).cast("double"), F.col(f"__mean_{score}"), F.col(f"__sd_{score}")),
            }
        ).drop("__rn")
    added = [f"{name}_{kind}" for name in scores for kind in ("rank", "pct", "z")]
    return out.select(*base, *added)


def average_rank_table(
    frame: DataFrame,
    keys: Sequence[str],
    score: str,
    descending: bool = True,
    group_limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """``(keys, score, tied, avg_rank)``: the average rank of every distinct score.

    Equal scores are counted before the shuffle, so ties cost nothing; the ranks
    come from running sums over the distinct scores.
    """
    x = F.col(score)
    counts = frame.where(x.isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("tied"))
    order = x.desc() if descending else x.asc()
    running = group_running(counts, keys, [order], F.col("tied"), "__upto", group_limit)
    return running.withColumn("avg_rank", F.col("__upto") - (F.col("tied") - 1) / 2.0).drop("__upto")


def average_ranks(
    frame: DataFrame,
    scores: Mapping[str, str],
    keys: Sequence[str] = ("run_id", "target_keyword_id"),
    group_limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Tie-averaged ranks: equal scores share their mean rank.

    Percentile only where the group has more than one score; z only where the
    deviation is defined and not 0.
    """
    base = frame.columns
    out = attach_group_stats(frame, keys, _moments(list(scores.values())))
    for name, score in scores.items():
        table = average_rank_table(frame, keys, score, True, group_limit)
        ranks = table.withColumnRenamed("avg_rank", "__avg").drop("tied")
        n = F.col(f"__n_{score}")
        out = (
            join_null_safe(out, ranks, [*keys, score], "left")
            .withColumns(
                {
                    f"{name}_rank": F.col("__avg"),
                    f"{name}_pct": F.when(
                        F.col(score).isNotNull() & (n > 1), (F.col("__avg") - 1) / F.nullif(n - 1, F.lit(0))
                    ),
                    f"{name}_z": zscore(
                        F.col(score).cast("double"), F.col(f"__mean_{score}"), F.col(f"__sd_{score}")
                    ),
                }
            )
            .drop("__avg")
        )
    added = [f"{name}_{kind}" for name in scores for kind in ("rank", "pct", "z")]
    return out.select(*base, *added)


def within_group_zscore(
    frame: DataFrame, score: str, keys: Sequence[str] = ("target_keyword_id",), out: str = "similarity_z"
) -> DataFrame:
    """z-score per group; groups with one row or no spread are dropped."""
    stats = attach_group_stats(frame, keys, _moments([score]))
    z = zscore(F.col(score).cast("double"), F.col(f"__mean_{score}"), F.col(f"__sd_{score}"))
    return stats.where(F.col(f"__sd_{score}") > 0).withColumn(out, z).select(*frame.columns, out)


def dropped_by_zscore(frame: DataFrame, score: str, keys: Sequence[str] = ("target_keyword_id",)) -> DataFrame:
    """How many rows :func:`within_group_zscore` leaves out, as a one-row frame."""
    per_group = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *_moments([score]))
    kept = F.coalesce(F.col(f"__sd_{score}") > 0, F.lit(False))
    return per_group.agg(
        F.coalesce(F.sum(F.when(~kept, F.col("__rows")).otherwise(0)), F.lit(0)).cast("bigint").alias("dropped_rows"),
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("bigint").alias("total_rows"),
    )


def run_zscore(frame: DataFrame, score: str, keys: Sequence[str] = ("run_id",), out: str = "z") -> DataFrame:
    """z-score where no spread gives 0 instead of null."""
    stats = attach_group_stats(frame, keys, _moments([score]))
    z = zscore(F.col(score).cast("double"), F.col(f"__mean_{score}"), F.col(f"__sd_{score}"), F.lit(0.0))
    return stats.withColumn(out, z).select(*frame.columns, out)


def global_zscore(frame: DataFrame, score: str, out: str = "z") -> DataFrame:
    return run_zscore(frame, score, (), out)


def demean(frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("target_keyword_id",)) -> DataFrame:
    """``<column>_within``: deviation from the group mean."""
    stats = attach_group_stats(frame, keys, [F.avg(F.col(c)).alias(f"__mean_{c}") for c in columns])
    return stats.select(
        *frame.columns, *[(F.col(c) - F.col(f"__mean_{c}")).alias(f"{c}_within") for c in columns]
    )


def suffix_sums(
    frame: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("target_keyword_id",),
    order: Sequence[str] = ("serp_rank",),
) -> DataFrame:
    """``<column>_suffix``: sum from this row to the end of its group.

    Written as a running sum over the reversed order, which is linear, while a
    frame that ends at "unbounded following" is summed anew for every row.
    """
    window = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return frame.select(*frame.columns, *[F.sum(c).over(window).alias(f"{c}_suffix") for c in columns])


def score_report(pages: DataFrame, score: str, keys: Sequence[str] = ("target_keyword",), tie_order: Sequence[str] = ("url",)) -> DataFrame:
    """Pages of each key by one score, best first: ``rank`` and ``percentile`` ((rank - 1) / (n - 1), 0 for a
    single one).  Pages without the score are left out."""
    ranked = ordinal_ranks(pages.where(F.col(score).isNotNull()), {"report": score}, keys, tie_order)
    return ranked.select(*keys, *tie_order, score, F.col("report_rank").alias("rank"), F.col("report_pct").alias("percentile"))
