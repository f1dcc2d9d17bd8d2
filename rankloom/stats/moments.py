"""Sufficient statistics of regressions with group effects.

Every fit needs only counts, means and centred cross products per (model, group).
They are plain aggregates: partial results are combined before the shuffle, so a
group of any size costs one row per task, and all models are fitted in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt_signals(
    panel: DataFrame, signals: Sequence[str], keep: Sequence[str], name: str = "signal", value: str = "value"
) -> DataFrame:
    """Long form ``(keep, signal, value)`` without the missing values.

    The signals are exploded, not unpivoted: rows keep the partitioning they have, so that groups that lie together
    need no other shuffle.
    """
    entries = F.array(*[F.struct(F.lit(s).alias(name), F.col(s).cast("double").alias(value)) for s in signals])
    return panel.select(*keep, F.inline(entries)).where(F.col(value).isNotNull())


def pairs(names: Sequence[str]) -> list[tuple[int, int]]:
    """Index pairs of the upper triangle, row by row."""
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def complete(group: str, columns: Sequence[str]) -> Column:
    """Rows that a fit can use: the group and every column are there."""
    out = F.col(group).isNotNull()
    for c in columns:
        out = out & F.col(c).cast("double").isNotNull()
    return out


def group_moments(frame: DataFrame, model: Sequence[str], group: str, columns: Sequence[str], dropped: bool = False) -> DataFrame:
    """``(model, group, n, means, cross)``: means and centred cross products of the complete rows.

    ``cross`` holds the upper triangle.  Spark updates and merges co-moments in a
    stable way, so nothing is lost to cancellation.  With ``dropped`` the incomplete
    rows are counted too, and groups that have no others stay with ``n`` 0.
    """
    usable = complete(group, columns)
    if not dropped:
        frame, usable = frame.where(usable), F.lit(True)
    x = [F.when(usable, F.col(c).cast("double")) for c in columns]
    n = F.count(F.when(usable, 1))
    cells = [F.covar_pop(x[i], x[j]) * n for i, j in pairs(columns)]
    counted = [F.count(F.when(~usable, 1)).alias("dropped")] if dropped else []
    return frame.groupBy(*model, group).agg(n.alias("n"), F.array(*[F.avg(c) for c in x]).alias("means"), F.array(*cells).alias("cross"), *counted)


def model_moments(moments: DataFrame, model: Sequence[str], width: int) -> DataFrame:
    """``(model, n, groups, within, total, raw)`` from the group moments.

    Upper triangles of the pooled within-group, the overall centred and the
    uncentred cross products.
    """
    tri = pairs(range(width))
    n = F.col("n").cast("double")
    m = [F.col("means")[i] for i in range(width)]
    zero = F.lit(0.0)  # a model without a complete row
    sums = [F.coalesce(F.sum(n * m[i]), zero).alias(f"s{i}") for i in range(width)]
    within = [F.coalesce(F.sum(F.col("cross")[k]), zero).alias(f"w{k}") for k in range(len(tri))]
    between = [F.coalesce(F.sum(n * m[i] * m[j]), zero).alias(f"b{k}") for k, (i, j) in enumerate(tri)]
    counted = [F.sum("dropped").alias("dropped")] if "dropped" in moments.columns else []
    agg = moments.groupBy(*model).agg(
        F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("groups"), *counted, *sums, *within, *between
    )
    total = [
        F.col(f"w{k}") + F.col(f"b{k}") - F.col(f"s{i}") * F.col(f"s{j}") / F.greatest(F.col("n"), F.lit(1)) for k, (i, j) in enumerate(tri)
    ]
    raw = [F.col(f"w{k}") + F.col(f"b{k}") for k in range(len(tri))]
    return agg.select(
        *model,
        "n",
        "groups",
        *[c for c in ("dropped",) if c in agg.columns],
        F.array(*[F.col(f"w{k}") for k in range(len(tri))]).alias("within"),
        F.array(*total).alias("total"),
        F.array(*raw).alias("raw"),
    )


def square(upper: Sequence[float], width: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    out = np.zeros((width, width))
    for value, (i, j) in zip(upper, pairs(range(width))):
        out[i, j] = out[j, i] = value
    return out


def element(array: Column, index: int) -> Column:
    return F.get(array, F.lit(index))


def quadratic(left: Sequence[Column], matrix: Column, right: Sequence[Column]) -> Column:
    """``left' M right`` with ``M`` stored row by row in an array column."""
    width = len(right)
    out = F.lit(0.0)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out = out + a * element(matrix, i * width + j) * b
    return out


def linear(weights: Column, values: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for i, v in enumerate(values):
        out = out + element(weights, i) * v
    return out
