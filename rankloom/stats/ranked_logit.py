"""Rank-ordered logit: each ranked list is a sequence of choices from what remains.

The lists are written once, a row per list; a Newton step reads them and adds up
log-likelihood, gradient and Hessian of all models in the tasks (no shuffle of rows).
Only these few numbers per model reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from rankloom.functions.dist import student_t_quantile, student_t_two_sided
from rankloom.functions.numeric import log1p_signed
from rankloom.operators.groups import join_measured
from rankloom.session import cut_lineage
from rankloom.stats.moments import pairs, square

# Iteration cap, gradient tolerance and condition limit.
MAX_ITERATIONS, GRADIENT_TOLERANCE, MAX_CONDITION = 1000, 1e-6, 1000.0
MAX_MODELS = 20_000


def stored_lists(
    frame: DataFrame,
    model: Sequence[str],
    group: str,
    signal: str,
    controls: Sequence[str] = (),
    rank: str = "serp_rank",
    max_rank: int = 20,
) -> DataFrame:
    """A row per list, written once: ``ranks`` from the last to the first, ``signals`` and ``controls`` row by row.

    ``whole`` tells whether the list can be fitted, ``rest`` whether it can without rank 1: a list needs two
    rows and must not repeat a rank.  Lists are cut at ``max_rank``, so an array is bounded.
    """
    rows = frame.where(F.col(rank).between(1, max_rank)).dropna(subset=[signal, *controls])
    item = F.struct(
        F.col(rank).cast("bigint").alias("r"),
        F.col(signal).cast("double").alias("s"),
        F.array(*[F.col(c).cast("double") for c in controls]).cast("array<double>").alias("c"),
    )
    items = rows.groupBy(*model, group).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    lists = items.select(
        *model,
        group,
        F.transform("items", lambda e: e["r"]).alias("ranks"),
        F.transform("items", lambda e: e["s"]).alias("signals"),
        F.flatten(F.transform("items", lambda e: e["c"])).alias("controls"),
    )

    def usable(ranks: Column) -> Column:
        return (F.size(ranks) >= 2) & (F.size(F.array_distinct(ranks)) == F.size(ranks))

    below = F.filter("ranks", lambda r: r > 1)
    marked = lists.select("*", usable(F.col("ranks")).alias("whole"), usable(below).alias("rest"))
    return cut_lineage(marked.where("whole or rest"))


def _ready(stored: DataFrame, model: Sequence[str], first: int = 1) -> DataFrame:
    """Lists from rank ``first`` on that can be fitted, with the lowest signal of their model."""
    lists = stored.where("whole" if first == 1 else "rest").select("*", F.lit(first).alias("first"))
    seen = F.zip_with("ranks", "signals", lambda r, s: F.when(r >= first, s))
    low = F.min(F.array_min(seen)).alias("low")
    if model:
        return join_measured(lists, lists.groupBy(*model).agg(low), list(model), "left")
    return lists.crossJoin(F.broadcast(lists.agg(low)))  # exactly one row


def prepare_lists(
    frame: DataFrame,
    model: Sequence[str],
    group: str,
    signal: str,
    controls: Sequence[str] = (),
    rank: str = "serp_rank",
    max_rank: int = 20,
) -> DataFrame:
    """Choice sets ready for fitting, a row per list.

    The signal is fitted as ``log1p``, signed if the model has any negative value.  Lists with
    a repeated rank and lists of one row are left out.  Lists are cut at
    ``max_rank``, so a list is bounded.
    """
    return _ready(stored_lists(frame, model, group, signal, controls, rank, max_rank), model)


def _fields(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)


def _list_terms(batch: pa.RecordBatch, width: int):
    """``(starts, x, l, g, h)`` of the rows of a batch of lists, last rank first.

    ``l`` is the log-likelihood term, ``g`` the score terms, ``h`` the Hessian terms (upper triangle).
    Sums over the remaining choices are running sums from the last rank on.
    Utilities are shifted by the maximum of the list, so no exponential overflows.
    """
    lengths = batch.column(batch.schema.get_field_index("ranks")).value_lengths().to_numpy(zero_copy_only=False)
    of_row = np.repeat(np.arange(len(lengths)), lengths)
    kept = _fields(batch, "ranks") >= _fields(batch, "first")[of_row]
    signals, of_row_kept = _fields(batch, "signals").astype(float)[kept], of_row[kept]
    signed = _fields(batch, "low").astype(float)[of_row_kept] < 0
    x0 = np.where(signed, np.sign(signals) * np.log1p(np.abs(signals)), np.log1p(np.maximum(signals, 0.0)))
    controls = _fields(batch, "controls").astype(float).reshape(len(of_row), width - 1)[kept]
    x = np.column_stack([x0, controls])
    starts = np.concatenate([[0], np.cumsum(np.bincount(of_row_kept, minlength=len(lengths)))]).astype(int)
    place = np.arange(len(x)) - starts[of_row_kept]
    b = _fields(batch, "__b").astype(float).reshape(len(lengths), width)
    u = (x * b[of_row_kept]).sum(axis=1)
    u = u - np.maximum.reduceat(u, starts[:-1])[of_row_kept]
    tri = pairs(range(width))
    values = np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i, j in tri]]) * np.exp(u)[:, None]
    padded = np.zeros((len(lengths), int(np.diff(starts).max()), values.shape[1]))
    padded[of_row_kept, place] = values
    sums = np.cumsum(padded, axis=1)[of_row_kept, place]
    mean = sums[:, 1:] / sums[:, :1]
    g = x - mean[:, :width]
    h = np.column_stack([mean[:, i] * mean[:, j] - mean[:, width + k] for k, (i, j) in enumerate(tri)])
    return starts, x, u - np.log(sums[:, 0]), g, h


def _with_params(lists: DataFrame, model: Sequence[str], params: dict) -> tuple[DataFrame, DataFrame]:
    """Lists of the models in ``params`` with the model's number ``__m`` and parameters ``__b``, and that table."""
    spark = lists.sparkSession
    fields = [lists.schema[m] for m in model]
    rows = [(*key, i, [float(v) for v in values]) for i, (key, values) in enumerate(params.items())]
    schema = StructType([*fields, StructField("__m", LongType()), StructField("__b", ArrayType(DoubleType()))])
    # One row per fitted model: the number of models is checked by the caller.
    table = F.broadcast(spark.createDataFrame(rows, schema))
    joined = lists.join(table, list(model), "inner") if model else lists.crossJoin(table)
    return joined.select("ranks", "signals", "controls", "first", "low", "__m", "__b"), table


def _summed(lists: DataFrame, model: Sequence[str], params: dict, names: Sequence[str], sums) -> tuple[DataFrame, DataFrame]:
    """``names`` of every task and model, added up in the task from ``sums(batch)``, a row per list; and the models."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of_list, values = _fields(batch, "__m"), sums(batch)
            for m in np.unique(of_list):
                own = values[of_list == m].sum(axis=0)
                total[int(m)] = total[int(m)] + own if int(m) in total else own
        if total:
            columns = [pa.array(list(total), pa.int64()), *[pa.array(v, pa.float64()) for v in np.array(list(total.values())).T]]
            yield pa.RecordBatch.from_arrays(columns, names=["__m", *names])

    joined, table = _with_params(lists, model, params)
    return joined.mapInArrow(task, ", ".join(["__m bigint", *[f"{n} double" for n in names]])), table


def newton_terms(lists: DataFrame, model: Sequence[str], group: str, params: dict, width: int) -> DataFrame:
    """One row per model: log-likelihood, gradient and Hessian (upper triangle)."""
    g, h = [f"g{i}" for i in range(width)], [f"h{k}" for k in range(len(pairs(range(width))))]

    def sums(batch):
        starts, _, loglik, score, curve = _list_terms(batch, width)
        return np.add.reduceat(np.column_stack([loglik, score, curve]), starts[:-1], axis=0)

    found, table = _summed(lists, model, params, ["l", *g, *h], sums)
    added = found.groupBy("__m").agg(
        F.sum("l").alias("loglik"), F.array(*[F.sum(c) for c in g]).alias("gradient"), F.array(*[F.sum(c) for c in h]).alias("hessian")
    )
    return added.join(table, "__m").select(*model, "loglik", "gradient", "hessian")


@dataclass
class Fit:
    params: np.ndarray
    loglik: float = float("nan")
    gradient: np.ndarray = field(default_factory=lambda: np.array([]))
    information: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    iterations: int = 0
    converged: bool = False
    previous: np.ndarray | None = None


def fit_lists(
    lists: DataFrame, model: Sequence[str], group: str, width: int, max_iterations: int = MAX_ITERATIONS
) -> dict[tuple, Fit]:
    """Newton's method for all models at once; each model stops on its own.

    A step that lowers the log-likelihood is halved.  The log-likelihood is concave,
    so few iterations are needed.
    """
    keys = [tuple(r) for r in lists.select(*model).distinct().limit(MAX_MODELS + 1).collect()] if model else [()]
    if len(keys) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models; fit them in portions")
    fits = {key: Fit(np.zeros(width)) for key in keys}
    best = {key: (-np.inf, np.zeros(width)) for key in keys}
    active = set(keys)
    for step in range(1, max_iterations + 1):
        if not active:
            break
        found = newton_terms(lists, model, group, {k: fits[k].params for k in active}, width).collect()
        for row in found:
            key = tuple(row[m] for m in model)
            fit = fits[key]
            fit.iterations = step
            low, base = best[key]
            if row["loglik"] < low - 1e-9 * max(1.0, abs(low)):
                fit.params = (fit.params + base) / 2.0
                if np.linalg.norm(fit.params - base) < 1e-14:
                    active.discard(key)
                continue
            fit.loglik = float(row["loglik"])
            fit.gradient = np.array(row["gradient"], dtype=float)
            fit.information = -square(row["hessian"], width)
            best[key] = (fit.loglik, fit.params.copy())
            if np.linalg.norm(fit.gradient) <= GRADIENT_TOLERANCE:
                fit.converged = True
                active.discard(key)
                continue
            move = np.linalg.pinv(fit.information) @ fit.gradient
            if np.linalg.norm(move) <= 1e-12 * max(1.0, float(np.linalg.norm(fit.params))):
                fit.converged = True
                active.discard(key)
                continue
            fit.params = fit.params + move
    for key, fit in fits.items():
        fit.params = best[key][1]
    return fits


def condition_number(matrix: np.ndarray) -> float:
    values = np.linalg.svd(matrix, compute_uv=False)
    return float(values.max() / values.min()) if values.size and values.min() > 0 else float("inf")


def ranked_logit(
    frame: DataFrame,
    model: Sequence[str],
    group: str,
    signal: str,
    controls: Sequence[str] = (),
    rank: str = "serp_rank",
    max_rank: int = 20,
    without_top: bool = True,
) -> DataFrame:
    """Fit, clustered inference, odds ratio per standard deviation and drift without rank 1.

    Controls that are constant in all models are left out; one that does not vary within the
    lists of a single model has no information there, stays at 0, and is named in that model's
    ``omitted_controls``.  One row per model.
    """
    controls = _varying(frame, controls)
    width = 1 + len(controls)
    stored = stored_lists(frame, model, group, signal, controls, rank, max_rank)
    lists = _ready(stored, model)
    fits = fit_lists(lists, model, group, width)
    ready = {k: f for k, f in fits.items() if f.information.size}
    if not ready:
        return lists.sparkSession.createDataFrame([], _result_schema(lists, model, controls))
    tri = pairs(range(width))
    meat = [f"u{k}" for k in range(len(tri))]

    def sums(batch):
        starts, x, _, g, _ = _list_terms(batch, width)
        u = np.add.reduceat(g, starts[:-1], axis=0)
        size = np.diff(starts)
        off = x[:, 0] - np.repeat(np.add.reduceat(x[:, 0], starts[:-1]) / size, size)
        spread = np.add.reduceat(off * off, starts[:-1]) / (size - 1)
        return np.column_stack([np.ones(len(size)), size, spread, *[u[:, i] * u[:, j] for i, j in tri]])

    found, table = _summed(lists, model, {k: f.params for k, f in ready.items()}, ["groups", "n", "v", *meat], sums)
    meats = found.groupBy("__m").agg(
        F.array(*[F.sum(c) for c in meat]).alias("meat"),
        F.sum("groups").cast("bigint").alias("groups"),
        F.sum("n").cast("bigint").alias("n"),
        F.sqrt(F.sum("v") / F.sum("groups")).alias("sd"),
    )
    meats = meats.join(table, "__m").drop("__m", "__b")
    s = F.col("s")
    x0 = F.when(F.col("low") < 0, log1p_signed(s)).otherwise(F.log1p(F.greatest(s, F.lit(0.0))))
    at = lambda i: F.get(F.col("controls"), F.col("at") * (width - 1) + i - 1)
    rows = lists.select(*model, "low", "controls", F.posexplode("signals").alias("at", "s"))
    spreads = rows.groupBy(*model).agg(F.array(*[F.stddev_samp(at(i) if i else x0) for i in range(width)]).alias("spread"))
    sizes = lists.groupBy(*model).agg(F.min(F.size("ranks")).alias("smallest"), F.max(F.size("ranks")).alias("largest"))
    side = meats.join(spreads, list(model)).join(sizes, list(model)) if model else meats.crossJoin(spreads).crossJoin(sizes)
    drift = {}
    if without_top:
        rest = _ready(stored, model, first=2)
        drift = fit_lists(rest, model, group, width)
    rows = []
    for r in side.collect():  # one row per model
        key = tuple(r[m] for m in model)
        rows.append((*key, *_result(ready[key], r, controls, drift.get(key))))
    return lists.sparkSession.createDataFrame(rows, _result_schema(lists, model, controls))


def _varying(frame: DataFrame, controls: Sequence[str]) -> list[str]:
    if not controls:
        return []
    row = frame.agg(*[(F.min(c) < F.max(c)).alias(c) for c in controls]).first()
    return [c for c in controls if row[c]]


def _result(fit: Fit, side, controls: Sequence[str], drift: Fit | None) -> tuple:
    width = 1 + len(controls)
    inverse = np.linalg.pinv(fit.information)
    v = inverse @ square(side["meat"], width) @ inverse
    se = np.sqrt(np.maximum(np.diag((v + v.T) / 2.0), 0.0))
    df = max(int(side["groups"]) - 1, 1)
    b, s, sd = float(fit.params[0]), float(se[0]), float(side["sd"] or 0.0)
    p = float(student_t_two_sided(b / s, float(df))) if s > 0 else 1.0
    half = float(student_t_quantile(0.975, float(df))) * s
    # Information of a control that varies is of the order of rows times variance.
    least = [0.0, *[1e-9 * int(side["n"]) * float(side["spread"][i] or 0.0) ** 2 for i in range(1, width)]]
    kept = [i for i in range(width) if i == 0 or fit.information[i, i] > least[i]]
    condition = condition_number(fit.information[np.ix_(kept, kept)])
    confirmed = fit.converged and condition <= MAX_CONDITION
    bounded = lambda x: float(np.exp(np.clip(x, -700.0, 700.0)))
    effects = [float(fit.params[i] * (side["spread"][i] or 0.0)) if i in kept else 0.0 for i in range(1, width)]
    moved = None if drift is None or not drift.information.size else float(drift.params[0]) * sd
    change = None if moved is None else moved - b * sd
    return (
        "computed" if confirmed else "unstable",
        int(side["n"]),
        int(side["groups"]),
        int(side["smallest"]),
        int(side["largest"]),
        fit.iterations,
        bool(confirmed),
        condition,
        float(fit.loglik),
        b,
        s,
        p,
        sd,
        b * sd,
        (b - half) * sd,
        (b + half) * sd,
        bounded(b * sd),
        effects,
        moved,
        change,
        None if change is None or b * sd == 0 else change / (b * sd),
        [c for i, c in enumerate(controls) if i + 1 not in kept],
    )


def _result_schema(lists: DataFrame, model: Sequence[str], controls: Sequence[str]):
    kinds = {
        "status": StringType(),
        "n": LongType(),
        "groups": LongType(),
        "smallest_set": LongType(),
        "largest_set": LongType(),
        "iterations": LongType(),
        "converged": BooleanType(),
        "condition_number": DoubleType(),
        "log_likelihood": DoubleType(),
        "coefficient": DoubleType(),
        "standard_error": DoubleType(),
        "p_value": DoubleType(),
        "signal_sd": DoubleType(),
        "log_odds_per_sd": DoubleType(),
        "ci_low": DoubleType(),
        "ci_high": DoubleType(),
        "odds_ratio_per_sd": DoubleType(),
        "control_effects": ArrayType(DoubleType()),
        "log_odds_without_top": DoubleType(),
        "drift": DoubleType(),
        "relative_drift": DoubleType(),
        "omitted_controls": ArrayType(StringType()),
    }
    return StructType([*[lists.schema[m] for m in model], *[StructField(n, t) for n, t in kinds.items()]])
