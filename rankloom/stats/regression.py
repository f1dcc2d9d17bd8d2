"""Least squares with group effects, for many models in one job.

Group dummies are never built: regressors and outcome are taken as deviations
from their group means (the slopes are the same), and the degrees of freedom
count the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from rankloom.functions.dist import student_t_quantile, student_t_two_sided, t_two_sided
from rankloom.operators.groups import group_percentiles, join_null_safe
from rankloom.session import cut_lineage
from rankloom.stats.moments import (
    complete,
    element,
    group_moments,
    linear,
    model_moments,
    pairs,
    quadratic,
    square,
)

RANK_TOLERANCE = 1e-10

_D = ArrayType(DoubleType())


def _fields(spec: dict) -> list[StructField]:
    return [StructField(n, t) for n, t in spec.items()]


_FIT = _fields(
    {
        "status": StringType(),
        "reason": StringType(),
        "rank": LongType(),
        "df_resid": LongType(),
        "beta": _D,
        "inverse": _D,
        "rss": DoubleType(),
        "r_squared": DoubleType(),
        "adjusted_r_squared": DoubleType(),
        "aic": DoubleType(),
        "base_rss": DoubleType(),
        "base_r_squared": DoubleType(),
        "base_adjusted_r_squared": DoubleType(),
        "base_aic": DoubleType(),
    }
)


def subset_rss(within: np.ndarray, chosen: Sequence[int], y: int) -> tuple[float, int]:
    """Residual sum of squares and rank of the regression of ``y`` on a subset."""
    if not len(chosen):
        return float(within[y, y]), 0
    g = within[np.ix_(chosen, chosen)]
    inverse, rank = stable_inverse(g)
    v = within[chosen, y]
    return float(max(within[y, y] - v @ inverse @ v, 0.0)), rank


def stable_inverse(gram: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank, judged on the scale-free correlation form."""
    d = np.sqrt(np.maximum(np.diag(gram), 0.0))
    safe = np.where(d > 0, d, 1.0)
    values, vectors = np.linalg.eigh(gram / np.outer(safe, safe))
    keep = values > RANK_TOLERANCE * max(1.0, values.max(initial=0.0))
    inner = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T if keep.any() else np.zeros_like(gram)
    return inner / np.outer(safe, safe), int(keep.sum())


def fit_quality(rss: float, tss: float, n: int, rank: int) -> tuple[float, float, float]:
    """R squared, adjusted R squared and AIC of a model of the given rank."""
    r2 = 1.0 - rss / tss if tss > 0 else float("nan")
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / (n - rank) if n > rank else float("nan")
    likelihood = -n / 2.0 * (math.log(2 * math.pi) + math.log(rss / n) + 1.0) if rss > 0 else float("inf")
    return r2, adjusted, -2.0 * likelihood + 2.0 * rank


def _solve_one(row, width: int, base: Sequence[int]) -> tuple:
    n, groups = int(row.n), int(row.groups)
    y = width
    within = square(row.within, width + 1)
    tss = square(row.total, width + 1)[y, y]
    nothing = (None,) * (len(_FIT) - 2)
    if n < 3:
        return ("skipped", "insufficient_rows", *nothing)
    inverse, rank_x = stable_inverse(within[:width, :width])
    d = np.diag(within)[:width]
    if d[0] <= 0 or inverse[0, 0] <= 0:
        return ("skipped", "parameter_not_estimable", *nothing)
    rank = rank_x + groups
    if n - rank <= 0 or n <= width + groups:
        return ("skipped", "insufficient_design", *nothing)
    beta = inverse @ within[:width, y]
    rss = float(max(within[y, y] - beta @ within[:width, y], 0.0))
    base_rss, base_rank = subset_rss(within, list(base), y)
    return (
        "computed",
        None if rank_x == width else "rank_deficient",
        rank,
        n - rank,
        beta.tolist(),
        inverse.ravel().tolist(),
        rss,
        *fit_quality(rss, tss, n, rank),
        base_rss,
        *fit_quality(base_rss, tss, n, base_rank + groups),
    )


def solve_models(moments: DataFrame, model: Sequence[str], width: int) -> DataFrame:
    """Solve the small normal equations of every model; a failed model is a row.

    The first regressor is the signal; the baseline keeps the others.  The matrices
    have ``width + 1`` columns, so a row is small and the rows are spread as they are.
    """
    head = [f for f in moments.schema.fields if f.name in (*model, "n", "groups", "dropped")]
    schema = StructType([*head, *_FIT])
    names = [f.name for f in head]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_solve_one(r, width, range(1, width)) for r in batch.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=[f.name for f in _FIT], index=batch.index)
            for c in ("rank", "df_resid"):
                out[c] = out[c].astype("Int64")
            yield pd.concat([batch[names], out], axis=1)

    return moments.mapInPandas(run, schema)


_INFERENCE = _fields(
    {
        "standard_errors": _D,
        "p_values": _D,
        "ci_low": _D,
        "ci_high": _D,
        "inference_df": LongType(),
        "covariance": StringType(),
    }
)


def sandwich_inference(fits: DataFrame, meat: DataFrame, model: Sequence[str], width: int) -> DataFrame:
    """Robust standard errors from ``meat`` = (model, meat, clusters, kind).

    ``kind`` is ``cluster`` (small-sample factor, clusters - 1 degrees of freedom
    for both test and interval) or ``HC3`` (residual degrees of freedom).
    """
    joined = join_null_safe(fits, meat, list(model), "left")
    schema = StructType([*fits.schema.fields, *_INFERENCE])
    names = fits.columns

    def spread(r) -> tuple | None:
        """Standard errors and degrees of freedom of one model."""
        if r.status != "computed" or r.meat is None:
            return None
        inverse = np.reshape(r.inverse, (width, width))
        v = inverse @ square(r.meat, width) @ inverse
        n, k, g = int(r.n), width + int(r.groups), int(r.clusters)
        if r.kind == "cluster":
            if g < 2 or n <= k:
                return None
            v = v * (g / (g - 1.0)) * ((n - 1.0) / (n - k))
        df = g - 1 if r.kind == "cluster" else int(r.df_resid)
        return np.sqrt(np.maximum(np.diag(v), 0.0)), df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spread(r) for r in batch.itertuples(index=False)]
            known = [i for i, f in enumerate(found) if f is not None]
            cells = [(None,) * len(_INFERENCE)] * len(batch)
            if known:
                # Tails and quantiles of the whole batch at once.
                se = np.array([found[i][0] for i in known])
                df = np.array([found[i][1] for i in known], dtype=float)
                beta = np.array([np.asarray(batch["beta"].iloc[i], dtype=float) for i in known])
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = student_t_two_sided(beta / se, df[:, None])
                levels, where = np.unique(df, return_inverse=True)
                half = student_t_quantile(0.975, levels)[where][:, None] * se
                kinds = batch["kind"].iloc[known].tolist()
                for row, i in enumerate(known):
                    low, high = beta[row] - half[row], beta[row] + half[row]
                    cells[i] = (se[row].tolist(), p[row].tolist(), low.tolist(), high.tolist(), int(df[row]), kinds[row])
            out = pd.DataFrame(cells, columns=[f.name for f in _INFERENCE], index=batch.index)
            out["inference_df"] = out["inference_df"].astype("Int64")
            yield pd.concat([batch[names], out], axis=1)

    return joined.mapInPandas(run, schema)


def cluster_meat(moments: DataFrame, fits: DataFrame, model: Sequence[str], width: int) -> DataFrame:
    """Sum of outer products of the group scores, from the group moments alone."""
    tri = {p: k for k, p in enumerate(pairs(range(width + 1)))}

    def c(i, j):
        return element(F.col("cross"), tri[(min(i, j), max(i, j))])

    joined = join_null_safe(moments.where("n > 0"), fits.where("status = 'computed'").select(*model, "beta"), list(model), "inner")
    scores = [c(i, width) - linear(F.col("beta"), [c(i, j) for j in range(width)]) for i in range(width)]
    scored = joined.select(*model, *[s.alias(f"u{i}") for i, s in enumerate(scores)])
    return scored.groupBy(*model).agg(
        F.array(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i, j in pairs(range(width))]).alias("meat"),
        F.count(F.lit(1)).alias("clusters"),
        F.lit("cluster").alias("kind"),
    )


def fitted_rows(
    frame: DataFrame, moments: DataFrame, fits: DataFrame, model: Sequence[str], group: str, columns: Sequence[str], outcome: str
) -> DataFrame:
    """Rows with within-group regressors ``x0..``, residual, fitted value and leverage."""
    width = len(columns)
    means = moments.select(*model, group, F.col("means"), F.col("n").alias("group_n"))
    models = fits.where("status = 'computed'").select(
        *model, "beta", "inverse", "rss", "df_resid", F.col("n").alias("model_n"), F.col("groups").alias("model_groups")
    )
    usable = frame.where(complete(group, [*columns, outcome]))
    # No usable row lacks its group; a plain equality lets rows that lie together by group stay where they are.
    other = means.select(*[F.col(c).alias(f"__r_{c}") for c in (*model, group)], "means", "group_n")
    same = F.col(group) == F.col(f"__r_{group}")
    for c in model:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    met = usable.join(other, same).drop(*[f"__r_{c}" for c in (*model, group)])
    joined = join_null_safe(met, models, list(model), "inner")
    xs = [F.col(c).cast("double") - element(F.col("means"), i) for i, c in enumerate(columns)]
    kept = [c for c in frame.columns]
    with_x = joined.select(
        *kept,
        *[x.alias(f"x{i}") for i, x in enumerate(xs)],
        (F.col(outcome) - element(F.col("means"), width)).alias("__y"),
        "group_n",
        "beta",
        "inverse",
        "rss",
        "df_resid",
        "model_n",
        "model_groups",
    )
    x = [F.col(f"x{i}") for i in range(width)]
    residual = F.col("__y") - linear(F.col("beta"), x)
    return with_x.withColumns(
        {
            "residual": residual,
            "fitted": F.col(outcome) - residual,
            "leverage": F.least(F.lit(1.0), 1.0 / F.col("group_n") + quadratic(x, F.col("inverse"), x)),
        }
    ).drop("__y")


def row_meat(rows: DataFrame, model: Sequence[str], width: int, cluster: Sequence[str] | None) -> DataFrame:
    """Meat from row scores: HC3 without clusters, else summed per cluster first."""
    if cluster is None:
        w = F.col("residual") / F.nullif(1.0 - F.col("leverage"), F.lit(0.0))
        scored = rows.select(*model, *[(F.col(f"x{i}") * w).alias(f"u{i}") for i in range(width)])
        clusters, kind = F.count(F.lit(1)), "HC3"
    else:
        scored = rows.groupBy(*model, *cluster).agg(
            *[F.sum(F.col(f"x{i}") * F.col("residual")).alias(f"u{i}") for i in range(width)]
        )
        clusters, kind = F.count(F.lit(1)), "cluster"
    return scored.groupBy(*model).agg(
        F.array(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i, j in pairs(range(width))]).alias("meat"),
        clusters.alias("clusters"),
        F.lit(kind).alias("kind"),
    )


def fit_models(
    frame: DataFrame, model: Sequence[str], group: str, columns: Sequence[str], outcome: str = "outcome"
) -> tuple[DataFrame, DataFrame]:
    """``(moments, fits)`` of the pooled regressions with group effects, over the complete rows.

    ``dropped`` counts the rows with a missing group, regressor or outcome.

    Both are read several times afterwards and far smaller than the rows, so they
    are written once.
    """
    width = len(columns)
    moments = cut_lineage(group_moments(frame, model, group, [*columns, outcome], dropped=True))
    return moments, cut_lineage(solve_models(model_moments(moments, model, width + 1), model, width))


def regression_table(
    frame: DataFrame, model: Sequence[str], group: str, columns: Sequence[str], outcome: str = "outcome"
) -> DataFrame:
    """Fits with robust inference: clustered by group, HC3 where there is one group.

    Clustered models never go back to the rows; only one-group models do.
    """
    width = len(columns)
    moments, fits = fit_models(frame, model, group, columns, outcome)
    many, single = fits.where("groups > 1 or status <> 'computed'"), fits.where("groups = 1 and status = 'computed'")
    clustered = sandwich_inference(many, cluster_meat(moments, many, model, width), model, width)
    rows = fitted_rows(frame, moments, single, model, group, columns, outcome)
    hc3 = sandwich_inference(single, row_meat(rows, model, width, None), model, width)
    return clustered.unionByName(hc3)


def two_way_table(
    frame: DataFrame,
    model: Sequence[str],
    group: str,
    second: str,
    columns: Sequence[str],
    outcome: str = "outcome",
    parameter: int = 0,
) -> DataFrame:
    """Two-way clustered standard error of one slope: V(group) + V(second) - V(both).

    Models without a repeated second cluster are skipped.
    """
    width = len(columns)
    moments, fits = fit_models(frame, model, group, columns, outcome)
    rows = fitted_rows(frame, moments, fits, model, group, columns, outcome)
    parts = {
        "g": cluster_meat(moments, fits, model, width),
        "s": row_meat(rows, model, width, [second]),
        "b": row_meat(rows, model, width, [group, second]),
    }
    out = fits.where("status = 'computed'").select(*model, "n", "groups", "beta", "inverse")
    for name, meat in parts.items():
        renamed = meat.select(*model, F.col("meat").alias(f"meat_{name}"), F.col("clusters").alias(f"n_{name}"))
        out = join_null_safe(out, renamed, list(model), "left")
    inverse_row = [element(F.col("inverse"), parameter * width + j) for j in range(width)]
    index = {p: k for k, p in enumerate(pairs(range(width)))}

    def variance(name):
        total = F.lit(0.0)
        for i in range(width):
            for j in range(width):
                total = total + inverse_row[i] * element(F.col(f"meat_{name}"), index[(min(i, j), max(i, j))]) * inverse_row[j]
        g = F.col(f"n_{name}").cast("double")
        n = F.col("n").cast("double")
        k = F.col("groups") + width
        return total * g / F.nullif(g - 1, F.lit(0.0)) * (n - 1) / F.nullif(n - k, F.lit(0.0))

    spread = F.sqrt(F.greatest(variance("g") + variance("s") - variance("b"), F.lit(0.0)))
    repeated = F.col("n_s") < F.col("n")
    return out.select(
        *model,
        F.when(repeated, "computed").otherwise("skipped").alias("status"),
        F.when(~repeated, "no_repeated_urls").alias("reason"),
        element(F.col("beta"), parameter).alias("coefficient"),
        F.when(repeated, spread).alias("standard_error"),
        F.greatest(F.lit(1).cast("bigint"), F.least("n_g", "n_s") - 1).alias("inference_df"),
    )


def signal_sd(frame: DataFrame, model: Sequence[str], group: str, column: str) -> DataFrame:
    """Root mean square of the sample deviations within the groups (single rows ignored)."""
    per_group = frame.groupBy(*model, group).agg(F.var_samp(F.col(column).cast("double")).alias("__v"))
    return per_group.groupBy(*model).agg(F.coalesce(F.sqrt(F.avg("__v")), F.lit(0.0)).alias("signal_sd"))


def effect_size(
    table: DataFrame, frame: DataFrame, model: Sequence[str], group: str, column: str, rank: str = "serp_rank"
) -> DataFrame:
    """Approximate rank change per standard deviation of the signal, at the median rank."""
    sd = signal_sd(frame, model, group, column)
    middle = group_percentiles(frame, model, rank, {"median_rank": 0.5})
    coefficient = element(F.col("beta"), 0)
    return (
        table.join(sd, list(model), "left")
        .join(middle, list(model), "left")
        .withColumn(
            "rank_change_per_sd", F.col("median_rank") * (F.exp(-(coefficient * F.col("signal_sd"))) - 1.0)
        )
    )


def slope_table(frame: DataFrame, model: Sequence[str], group: str, column: str, outcome: str = "outcome") -> DataFrame:
    """One regressor with group effects and clustered inference, in closed form.

    Pure column arithmetic, for very many models (one per entity and metric).
    """
    return slopes_from_moments(cut_lineage(group_moments(frame, model, group, [column, outcome])), model)


def slopes_from_moments(moments: DataFrame, model: Sequence[str]) -> DataFrame:
    """The same from ``(model, group, n, cross)`` with cross = [xx, xy, yy]."""
    cxx, cxy, cyy = (element(F.col("cross"), i) for i in range(3))
    totals = moments.groupBy(*model).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(cxx).alias("sxx"),
        F.sum(cxy).alias("sxy"),
        F.sum(cyy).alias("syy"),
    )
    slopes = totals.withColumn("coefficient", F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))))
    score = cxy - F.col("coefficient") * cxx
    meat = (
        moments.join(slopes.select(*model, "coefficient"), list(model), "inner")
        .groupBy(*model)
        .agg(F.sum(score * score).alias("meat"))
    )
    g, n = F.col("groups").cast("double"), F.col("n").cast("double")
    factor = g / F.nullif(g - 1, F.lit(0.0)) * (n - 1) / F.when(n > g + 1, n - g - 1)
    joined = slopes.join(meat, list(model), "left").withColumn(
        "standard_error", F.sqrt(F.col("meat") * factor) / F.nullif(F.col("sxx"), F.lit(0.0))
    )
    t = F.col("coefficient") / F.nullif(F.col("standard_error"), F.lit(0.0))
    return joined.select(
        *model,
        "n",
        "groups",
        "coefficient",
        "standard_error",
        t_two_sided(t, F.col("groups").cast("double") - 1).alias("p_value"),
        (1.0 - (F.col("syy") - F.col("coefficient") * F.col("sxy")) / F.nullif(F.col("syy"), F.lit(0.0))).alias(
            "within_r_squared"
        ),
    )
