"""Influence, specification and collinearity checks of fitted models."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from rankloom.functions.dist import chi2_tail, f_tail
from rankloom.operators.groups import GROUP_ROWS_PER_TASK, join_null_safe
from rankloom.operators.ranks import average_rank_table
from rankloom.session import cut_lineage
from rankloom.stats.moments import element, group_moments, melt_signals, model_moments, square
from rankloom.stats.regression import (
    cluster_meat,
    fit_models,
    fitted_rows,
    sandwich_inference,
    solve_models,
    stable_inverse,
)

# Flags and test levels.
STUDENTIZED_LIMIT = 3.0
MIN_RESET_DF = 20
RESET_LEVEL = BREUSCH_PAGAN_LEVEL = 0.05
MAX_VIF = 5.0


def influence_rows(
    frame: DataFrame, model: Sequence[str], group: str, columns: Sequence[str], outcome: str = "outcome"
) -> DataFrame:
    """Leverage, Cook's distance, studentised residual, DFFITS and slope DFBETAS per row.

    All from row expressions with the coefficients and the inverse matrix of the
    row's model; the flags use the usual size-dependent limits.  ``max_abs_dfbeta``
    covers the slopes (the group dummies have no place in a row-wise formula).
    """
    width = len(columns)
    moments, fits = fit_models(frame, model, group, columns, outcome)
    rows = fitted_rows(frame, moments, fits, model, group, columns, outcome)
    x = [F.col(f"x{i}") for i in range(width)]
    n, k = F.col("model_n").cast("double"), (F.col("model_groups") + width).cast("double")
    h, e, df = F.col("leverage"), F.col("residual"), F.col("df_resid").cast("double")
    # A row that determines its own fitted value has no defined influence.
    free = F.when(h < 1.0 - 1e-12, 1.0 - h)
    s2 = F.col("rss") / df
    internal2 = e * e / F.nullif(s2 * free, F.lit(0.0))
    without2 = (F.col("rss") - e * e / free) / F.nullif(df - 1, F.lit(0.0))
    external = e / F.sqrt(F.nullif(without2 * free, F.lit(0.0)))
    steps = []
    for j in range(width):
        direction = sum((element(F.col("inverse"), j * width + i) * x[i] for i in range(width)), F.lit(0.0))
        scale = F.sqrt(F.nullif(without2 * element(F.col("inverse"), j * width + j), F.lit(0.0)))
        steps.append(direction * e / free / scale)
    out = rows.withColumns(
        {
            "cooks_d": internal2 * h / (free * k),
            "studentized_residual": external,
            "dffits": external * F.sqrt(h / free),
            **{f"dfbeta_{c}": step for c, step in zip(columns, steps)},
        }
    )
    betas = [F.abs(F.col(f"dfbeta_{c}")) for c in columns]
    out = out.withColumn("max_abs_dfbeta", F.greatest(*betas) if width > 1 else betas[0])
    limits = {
        "cooks_flag": F.col("cooks_d") > 4.0 / n,
        "leverage_flag": h > 2.0 * k / n,
        "studentized_flag": F.abs("studentized_residual") > STUDENTIZED_LIMIT,
        "dffits_flag": F.abs("dffits") > 2.0 * F.sqrt(k / n),
        "dfbeta_flag": F.col("max_abs_dfbeta") > 2.0 / F.sqrt(n),
    }
    flagged = out.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in limits.items()})
    any_flag = F.lit(False)
    for name in limits:
        any_flag = any_flag | F.col(name)
    return flagged.withColumn("influential", any_flag).drop(
        *[f"x{i}" for i in range(width)], "beta", "inverse", "rss", "df_resid"
    )


def influence_summary(rows: DataFrame, model: Sequence[str]) -> DataFrame:
    """Row counts per flag and the influential rate per model."""
    flags = ("cooks", "leverage", "studentized", "dffits", "dfbeta")
    return rows.groupBy(*model).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(f"{f}_flag")).alias(f"{f}_count") for f in flags],
        F.count_if("influential").alias("influential_count"),
        F.avg(F.col("influential").cast("double")).alias("influential_rate"),
    )


def influence_refit(
    frame: DataFrame, model: Sequence[str], group: str, columns: Sequence[str], outcome: str = "outcome"
) -> DataFrame:
    """Refit without the rows over the Cook limit: coefficient and its change."""
    width = len(columns)
    rows = cut_lineage(
        influence_rows(frame, model, group, columns, outcome).select(*frame.columns, "cooks_flag")
    )
    _, full = fit_models(rows, model, group, columns, outcome)
    kept = rows.where("not cooks_flag")
    moments, trimmed = fit_models(kept, model, group, columns, outcome)
    refit = sandwich_inference(trimmed, cluster_meat(moments, trimmed, model, width), model, width)
    dropped = rows.groupBy(*model).agg(F.count_if("cooks_flag").alias("influential_row_count"), F.count(F.lit(1)).alias("row_count"))
    first = full.select(*model, element(F.col("beta"), 0).alias("confirmatory_coefficient"))
    second = refit.select(
        *model,
        F.col("n").alias("trimmed_row_count"),
        F.col("groups").alias("trimmed_keyword_count"),
        "status",
        "reason",
        element(F.col("beta"), 0).alias("sensitivity_coefficient"),
        element(F.col("ci_low"), 0).alias("ci_low"),
        element(F.col("ci_high"), 0).alias("ci_high"),
    )
    out = join_null_safe(join_null_safe(dropped, first, model, "left"), second, model, "left")
    return out.withColumn("coefficient_delta", F.col("sensitivity_coefficient") - F.col("confirmatory_coefficient"))


def specification_tests(
    frame: DataFrame,
    model: Sequence[str],
    group: str,
    columns: Sequence[str],
    outcome: str = "outcome",
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """RESET, Breusch-Pagan and residual-versus-fitted correlations per model.

    The rows with residual and fitted value are written once; RESET adds the squared
    fitted value as one more regressor, Breusch-Pagan regresses squared residuals on
    the same design.
    """
    width = len(columns)
    moments, fits = fit_models(frame, model, group, columns, outcome)
    rows = fitted_rows(frame, moments, fits, model, group, columns, outcome)
    kept = cut_lineage(
        rows.select(
            *model,
            group,
            *columns,
            outcome,
            "residual",
            "fitted",
            (F.col("fitted") * F.col("fitted")).alias("fitted_sq"),
            (F.col("residual") * F.col("residual")).alias("residual_sq"),
        )
    )
    _, wider = fit_models(kept, model, group, ["fitted_sq", *columns], outcome)
    _, spread = fit_models(kept, model, group, columns, "residual_sq")
    base = fits.where("status = 'computed'").select(*model, "n", "groups", "rss", "df_resid")
    joined = join_null_safe(
        base, wider.select(*model, F.col("rss").alias("__rss2"), F.col("df_resid").alias("__df2"), F.col("status").alias("__s2")), model, "left"
    )
    joined = join_null_safe(joined, spread.select(*model, F.col("r_squared").alias("__bp")), model, "left")

    # A constant side has no correlation; the guard keeps rounding noise from making one.
    ranks = kept.select(*model, "residual", "fitted")
    for column, out in (("residual", "__a"), ("fitted", "__b")):
        table = average_rank_table(kept, model, column, False, limit).withColumnRenamed("avg_rank", out).drop("tied")
        ranks = join_null_safe(ranks, table, [*model, column], "left")

    def correlation(a, b):
        scale = F.var_pop(a) * F.var_pop(b)
        return F.covar_pop(a, b) / F.sqrt(F.when(scale > 1e-24, scale))

    correlations = ranks.groupBy(*model).agg(
        correlation(F.col("fitted"), F.col("residual")).alias("pearson_r"),
        correlation(F.col("__a"), F.col("__b")).alias("spearman_r"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_sd"),
        F.avg("fitted").alias("fitted_mean"),
        F.stddev_samp("fitted").alias("fitted_sd"),
    )
    k = (F.col("groups") + width).cast("double")
    n = F.col("n").cast("double")
    enough = (F.col("df_resid") >= MIN_RESET_DF) & ~((n > 50) & (F.col("df_resid") < 40)) & (F.col("__s2") == "computed")
    reset = F.when(enough, (F.col("rss") - F.col("__rss2")) / F.nullif(F.col("__rss2") / F.col("__df2"), F.lit(0.0)))
    lm = n * F.col("__bp")
    f = (F.col("__bp") / (k - 1)) / F.nullif((1 - F.col("__bp")) / (n - k), F.lit(0.0))
    tested = joined.select(
        *model,
        "n",
        "groups",
        F.when(enough, "computed").otherwise("skipped").alias("reset_status"),
        reset.alias("reset_f"),
        f_tail(reset, F.lit(1.0), F.col("__df2").cast("double")).alias("reset_p_value"),
        lm.alias("bp_lm"),
        chi2_tail(lm, k - 1).alias("bp_lm_p_value"),
        f.alias("bp_f"),
        f_tail(f, k - 1, n - k).alias("bp_f_p_value"),
    )
    flagged = tested.withColumns(
        {
            "reset_flagged": F.coalesce(F.col("reset_p_value") < RESET_LEVEL, F.lit(False)),
            "bp_flagged": F.coalesce(
                (F.col("bp_lm_p_value") < BREUSCH_PAGAN_LEVEL) | (F.col("bp_f_p_value") < BREUSCH_PAGAN_LEVEL), F.lit(False)
            ),
        }
    ).withColumn("recommended_se", F.when(F.col("bp_flagged"), "HC3").otherwise("clustered"))
    return join_null_safe(flagged, correlations, model, "left")


def variance_inflation(frame: DataFrame, model: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Uncentred variance inflation factor of each column: ``G_jj * (G^-1)_jj``."""
    marked = frame.withColumn("__one", F.lit(0))
    moments = model_moments(group_moments(marked, model, "__one", columns), model, len(columns))
    return _vif_rows(moments, model, columns)


def _vif_rows(moments: DataFrame, model: Sequence[str], columns: Sequence[str]) -> DataFrame:
    head = [f for f in moments.schema.fields if f.name in model]
    schema = StructType([*head, StructField("term", StringType()), StructField("vif", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, r in batch.iterrows():
                factors = inflation_factors(square(r["raw"], len(columns)))
                rows += [(*[r[m] for m in model], c, float(v)) for c, v in zip(columns, factors)]
            yield pd.DataFrame(rows, columns=schema.names)

    return moments.mapInPandas(run, schema)


def inflation_factors(gram: np.ndarray) -> np.ndarray:
    if gram.shape[0] == 1:
        return np.ones(1)
    inverse, rank = stable_inverse(gram)
    if rank < gram.shape[0]:
        return np.full(gram.shape[0], np.inf)
    return np.diag(gram) * np.diag(inverse)


_STEP = {
    "step": LongType(),
    "term": StringType(),
    "coefficient": DoubleType(),
    "vif": DoubleType(),
    "dropped_before": StringType(),
    "status": StringType(),
    "final": BooleanType(),
}


def joint_model(
    frame: DataFrame,
    model: Sequence[str],
    group: str,
    scores: Sequence[str],
    controls: Sequence[str],
    drop_order: Sequence[str],
    outcome: str = "outcome",
    max_vif: float = MAX_VIF,
) -> DataFrame:
    """Joint regression of several scores that drops scores until no factor is too large.

    Scores leave in ``drop_order``; its last entry is protected.  One pass over the
    data gives the cross products; every step is a submatrix of them.  One row per
    step and term; ``final`` marks the resulting model.
    """
    columns = [*scores, *controls]
    complete = frame.dropna(subset=[*columns, outcome])
    width = len(columns)
    moments = model_moments(group_moments(complete, model, group, [*columns, outcome]), model, width + 1)
    head = [f for f in moments.schema.fields if f.name in (*model, "n", "groups")]
    schema = StructType([*head, *[StructField(n, t) for n, t in _STEP.items()]])
    protected = drop_order[-1]

    def steps(r):
        within, raw = square(r["within"], width + 1), square(r["raw"], width + 1)
        active, dropped, step = list(scores), [], 0
        while True:
            chosen = [columns.index(c) for c in (*active, *controls)]
            inverse, _ = stable_inverse(within[np.ix_(chosen, chosen)])
            beta = inverse @ within[chosen, width]
            factors = inflation_factors(raw[np.ix_(chosen, chosen)])
            fine = factors.max() <= max_vif
            following = next((s for s in drop_order if s in active and s != protected), None)
            status = "computed" if fine else "unresolved" if following is None else "dropped"
            for i, c in enumerate(chosen):
                yield step, columns[c], float(beta[i]), float(factors[i]), ",".join(dropped), status, status != "dropped"
            if status != "dropped":
                return
            active.remove(following)
            dropped.append(following)
            step += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*[r[f.name] for f in head], *cells) for _, r in batch.iterrows() for cells in steps(r)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return moments.mapInPandas(run, schema)


def explainability(
    frame: DataFrame,
    group: str,
    metric_groups: Mapping[str, Sequence[str]],
    controls: Sequence[str] = (),
    outcome: str = "outcome",
) -> DataFrame:
    """Adjusted R squared of each metric alone and of each set of metrics jointly.

    A metric alone is fitted on the rows that have it; a set on the rows that have
    all of it.  Metrics alone are one long job, sets one job each.
    """
    metrics = list(dict.fromkeys(m for ms in metric_groups.values() for m in ms))
    long = melt_signals(frame, metrics, [group, outcome, *controls])
    _, single = fit_models(long, ["signal"], group, ["value", *controls], outcome)
    parts = [
        single.select(
            F.lit("single").alias("kind"),
            F.col("signal").alias("name"),
            "n",
            "groups",
            "status",
            "r_squared",
            "adjusted_r_squared",
            (F.col("adjusted_r_squared") - F.col("base_adjusted_r_squared")).alias("adjusted_r_squared_delta"),
        )
    ]
    for name, members in metric_groups.items():
        rows = frame.dropna(subset=[*members, *controls, outcome]).withColumn("__set", F.lit(name))
        moments = group_moments(rows, ["__set"], group, [*members, *controls, outcome])
        joint = solve_models(
            model_moments(moments, ["__set"], len(members) + len(controls) + 1), ["__set"], len(members) + len(controls)
        )
        parts.append(
            joint.select(
                F.lit("joint").alias("kind"),
                F.col("__set").alias("name"),
                "n",
                "groups",
                "status",
                "r_squared",
                "adjusted_r_squared",
                F.lit(None).cast("double").alias("adjusted_r_squared_delta"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
