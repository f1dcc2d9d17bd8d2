"""Row-wise numeric transforms that skip nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (F.abs(x) < inf), x)


def log1p_signed(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def rank_outcome(rank: Column) -> Column:
    """``-ln(rank)``: larger is better, and steps shrink down the list."""
    return -F.ln(rank.cast("double"))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-null values of a row; null if all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return total / F.nullif(count, F.lit(0))


def all_present(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def any_present(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNotNull()
    return out


def zscore(x: Column, mean: Column, sd: Column, flat: Column | None = None) -> Column:
    """``(x - mean) / sd``; ``flat`` (default null) where sd is 0 or undefined."""
    value = (x - mean) / F.nullif(sd, F.lit(0.0))
    if flat is None:
        return value
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(value, flat))
