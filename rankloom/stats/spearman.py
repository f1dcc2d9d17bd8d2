"""Rank correlation per keyword and its summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from rankloom.functions.dist import t_two_sided
from rankloom.operators.groups import GROUP_ROWS_PER_TASK, attach_group_stats, group_percentiles, group_running, join_null_safe
from rankloom.operators.ranks import average_rank_table
from rankloom.session import cut_lineage

MIN_TESTS_FOR_ADJUSTMENT = 10


def _average_rank(column: str, keys: Sequence[str]) -> Column:
    """Tie-averaged rank in a bounded group."""
    x = F.col(column)
    lowest = F.rank().over(Window.partitionBy(*keys).orderBy(x))
    return lowest + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2.0


def keyword_correlations(
    frame: DataFrame,
    keys: Sequence[str],
    score: str,
    rank: str = "serp_rank",
    bounded: bool = True,
    min_rows: int = 2,
) -> DataFrame:
    """``(keys, n_rows, rho, p_value)`` for groups of at least ``min_rows`` pairs.

    ``bounded`` states that a group is a ranked list of limited depth, ranked by
    windows; otherwise average ranks come from counts of distinct values.  A
    constant side gives rho 0 and p 1.
    """
    rows = frame.where(F.col(score).isNotNull() & F.col(rank).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("__s"), F.col(rank).cast("double").alias("__r")
    )
    if bounded:
        ranked = rows.select(*keys, _average_rank("__s", keys).alias("__a"), _average_rank("__r", keys).alias("__b"))
    else:
        ranked = rows
        for column, out in (("__s", "__a"), ("__r", "__b")):
            table = average_rank_table(rows, keys, column, descending=False).withColumnRenamed("avg_rank", out)
            ranked = join_null_safe(ranked, table.drop("tied"), [*keys, column], "left")
    a, b = F.col("__a"), F.col("__b")
    per_key = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.covar_pop(a, b).alias("__ab"),
        F.var_pop(a).alias("__aa"),
        F.var_pop(b).alias("__bb"),
        ((F.min(a) == F.max(a)) | (F.min(b) == F.max(b))).alias("__flat"),
    )
    rho = F.when(F.col("__flat"), F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__ab") / F.sqrt(F.nullif(F.col("__aa") * F.col("__bb"), F.lit(0.0)))))
    )
    # Ranks are multiples of a half, so a correlation this small is exactly 0.
    exact = F.when(F.abs(F.col("rho")) < 1e-12, F.lit(0.0)).otherwise(F.col("rho"))
    tests = (
        per_key.where(F.col("n_rows") >= min_rows)
        .select(*keys, "n_rows", "__flat", rho.alias("rho"))
        .withColumn("rho", exact)
    )
    return tests.select(*keys, "n_rows", "rho", correlation_p_value("rho", "n_rows", "__flat").alias("p_value"))


#: Comparisons of two rows of a list that are held at once.
_COMPARED = 1 << 21


def _double_ranks(x: np.ndarray) -> np.ndarray:
    """How every row of a list stands to every other: 2 above, 1 equal, 0 below.  NaN is the largest value, as in Spark."""
    a, b = x[:, :, None], x[:, None, :]
    lost = np.isnan(x)
    above = (a > b) | (lost[:, :, None] & ~lost[:, None, :])
    equal = (a == b) | (lost[:, :, None] & lost[:, None, :])
    return (2 * above + equal).astype(np.float64)


def _list_tests(lists: pa.ListArray, scores: Sequence[str], depths: dict[str, int], min_rows: int) -> Iterator[tuple]:
    """``(places, depth, score, n_rows, rho, flat)`` of lists of (rank, scores): one array per column.

    Twice the average rank of a row is the sum of its comparisons with the rows of the depth, a whole number; so are
    the moments, and a correlation is rounded only in its last division.
    """
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    rows, width = lists.flatten(), int(sizes.max(initial=0))
    first = np.concatenate([[0], np.cumsum(sizes)])
    step = max(1, _COMPARED // max(width * width, 1))
    columns = {c: rows.field(c) for c in ("__r", *scores)}
    known = {c: np.asarray(v.is_valid()) for c, v in columns.items()}
    values = {c: np.asarray(v.fill_null(0.0), dtype=np.float64) for c, v in columns.items()}
    for low in range(0, len(sizes), step):
        part = np.arange(low, min(low + step, len(sizes)))
        inside = np.arange(width) < sizes[part, None]
        at = np.where(inside, first[part, None] + np.arange(width), 0)
        rank, ranked = values["__r"][at], inside & known["__r"][at]
        by_rank = _double_ranks(rank)
        for score in scores:
            by_score, scored = _double_ranks(values[score][at]), ranked & known[score][at]
            for depth, limit in depths.items():
                v = (scored & (rank >= 1) & (rank <= limit)).astype(np.float64)
                a, b = ((m @ v[:, :, None])[:, :, 0] * v for m in (by_score, by_rank))
                n = v.sum(axis=1)
                aa, bb, ab = (n * (x * y).sum(axis=1) - x.sum(axis=1) * y.sum(axis=1) for x, y in ((a, a), (b, b), (a, b)))
                flat = (aa == 0) | (bb == 0)
                rho = np.where(flat, 0.0, np.clip(ab / np.sqrt(np.where(flat, 1.0, aa) * np.where(flat, 1.0, bb)), -1.0, 1.0))
                enough = np.flatnonzero(n >= min_rows)
                yield part[enough], depth, score, n[enough].astype(np.int64), rho[enough], flat[enough]


def list_correlations(
    frame: DataFrame, keys: Sequence[str], scores: Sequence[str], depths: dict[str, int], rank: str = "serp_rank", min_rows: int = 2
) -> DataFrame:
    """``(rank_depth, signal, keys, n_rows, rho, p_value)``: :func:`keyword_correlations` of all scores at all depths.

    For ranked lists of limited depth.  A list travels once, as one row; neither the depths nor the scores multiply
    the rows that are shuffled or sorted.
    """
    row = F.struct(F.col(rank).cast("double").alias("__r"), *[F.col(c).cast("double").alias(c) for c in scores])
    lists = frame.groupBy(*keys).agg(F.collect_list(row).alias("__rows"))
    names = ["rank_depth", "signal", *keys, "n_rows", "rho", "__flat"]
    kinds = [StringType(), StringType(), *[frame.schema[k].dataType for k in keys], LongType(), DoubleType(), BooleanType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for places, depth, score, n, rho, flat in _list_tests(batch.column("__rows"), scores, depths, min_rows):
                if len(places):
                    own = [batch.column(k).take(pa.array(places)) for k in keys]
                    fixed = [pa.array([text] * len(places), pa.string()) for text in (depth, score)]
                    yield pa.RecordBatch.from_arrays([*fixed, *own, pa.array(n), pa.array(rho), pa.array(flat)], names=names)

    tests = lists.mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, kinds)]))
    return tests.select(*names[:-2], "rho", correlation_p_value("rho", "n_rows", "__flat").alias("p_value"))


def correlation_p_value(rho: str, rows: str, flat: str) -> Column:
    """Two-sided p of a rank correlation from t with ``rows - 2`` degrees of freedom."""
    r, df = F.col(rho), F.col(rows) - 2
    # Perfect agreement: rounding must not turn an infinite t into a large finite one.
    perfect = 1.0 - r * r < 1e-12
    t = r * F.sqrt(df / F.nullif(1.0 - r * r, F.lit(0.0)))
    return (
        F.when(F.col(flat) | (df <= 0), F.lit(1.0))
        .when(perfect, F.lit(0.0))
        .otherwise(F.coalesce(t_two_sided(t, df.cast("double")), F.lit(1.0)))
    )


def adjust_p_values(
    tests: DataFrame,
    family: Sequence[str],
    p: str = "p_value",
    out: str = "bh_q_value",
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Benjamini-Hochberg q-values within each test family; null p-values stay out.

    q depends on the p-value alone, so equal p-values are counted first and the
    step-up minimum runs over the distinct ones.  The tests are written once: the
    q-values are joined back by p-value, which a second evaluation in another merge
    order could change in the last digit.
    """
    tests = cut_lineage(tests)
    counted = tests.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("__c"))
    upto = group_running(counted, family, [F.col(p).asc()], F.col("__c"), "__upto", limit)
    sized = attach_group_stats(upto, family, [F.sum("__c").alias("__m")])
    raw = F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__upto"))
    adjusted = group_running(sized.withColumn("__q", raw), family, [F.col(p).desc()], F.col("__q"), out, limit, "min")
    return join_null_safe(tests, adjusted.select(*family, p, out), [*family, p], "left")


def summarize_correlations(tests: DataFrame, group: Sequence[str], limit: int | None = GROUP_ROWS_PER_TASK) -> DataFrame:
    """Median, interquartile range and share with the sign of the median, per group."""
    middle = group_percentiles(tests, group, "rho", {"median_rho": 0.5, "q1": 0.25, "q3": 0.75}, limit)
    joined = join_null_safe(tests.select(*group, "rho"), middle, group, "inner")
    same = (F.signum("rho") == F.signum("median_rho")).cast("double")
    return joined.groupBy(*group).agg(
        F.count(F.lit(1)).alias("keyword_count"),
        F.max("median_rho").alias("median_rho"),
        F.max(F.col("q3") - F.col("q1")).alias("rho_iqr"),
        F.avg(same).alias("fraction_same_sign"),
    ).withColumn(
        "status", F.when(F.col("keyword_count") >= MIN_TESTS_FOR_ADJUSTMENT, "computed").otherwise("skipped")
    ).withColumn("bh_skipped_reason", F.when(F.col("status") == "skipped", "underpowered"))


def adjusted_tests(tests: DataFrame, family: Sequence[str]) -> DataFrame:
    """q-values for families with enough tests, null elsewhere."""
    sized = attach_group_stats(tests, family, [F.count(F.lit(1)).alias("__tests")])
    usable = F.when(F.col("__tests") >= MIN_TESTS_FOR_ADJUSTMENT, F.col("p_value"))
    marked = adjust_p_values(sized.withColumn("__p", usable), family, "__p")
    return marked.drop("__p", "__tests")


# Thresholds of an association worth acting on.
MIN_MEDIAN_RHO, MIN_SAME_SIGN = 0.25, 0.60


def inference_mode(keyword_count: Column) -> Column:
    return (
        F.when(keyword_count == 0, "skipped")
        .when(keyword_count == 1, "underpowered")
        .when(keyword_count < MIN_TESTS_FOR_ADJUSTMENT, "exploratory")
        .otherwise("confirmatory")
    )


def is_actionable(
    median_rho: Column, same_sign: Column, ci_low: Column, ci_high: Column, min_rho=MIN_MEDIAN_RHO, min_sign=MIN_SAME_SIGN
) -> Column:
    """Strong enough, consistent enough, and an interval that excludes 0."""
    excludes = (ci_low > 0) | (ci_high < 0)
    return F.coalesce((F.abs(median_rho) >= min_rho) & (same_sign >= min_sign) & excludes, F.lit(False))
