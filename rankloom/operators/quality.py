"""Table contracts: structure checks without reading rows, row rules in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ContractError(ValueError):
    """A table does not keep its contract."""


# Rank columns whose upper bound is the requested depth.
DEPTH_BOUND_COLUMNS = (
    "serp_rank",
    "best_serp_rank",
    "worst_serp_rank",
    "bge_rank",
    "gemini_doc_retrieval_rank",
    "gemini_semantic_similarity_rank",
)


@dataclass(frozen=True)
class Contract:
    schema: StructType | None = None
    unique: tuple[str, ...] = ()
    non_null: tuple[str, ...] = ()
    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def at_depth(self, depth: int) -> "Contract":
        return Contract(self.schema, self.unique, self.non_null, depth_bounds(self.bounds, depth))


def depth_bounds(bounds, depth: int):
    if depth < 1:
        raise ValueError("depth must be at least 1")
    return {c: (lo, depth if c in DEPTH_BOUND_COLUMNS else hi) for c, (lo, hi) in bounds.items()}


def check_structure(frame: DataFrame, required: Iterable[str], schema: StructType | None = None) -> DataFrame:
    """Required columns and exact types; reads no rows."""
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ContractError("missing columns: " + ", ".join(missing))
    if schema is not None:
        actual = {f.name: f.dataType for f in frame.schema.fields}
        wrong = [
            f"{f.name}: expected {f.dataType.simpleString()}, "
            f"found {actual[f.name].simpleString() if f.name in actual else 'nothing'}"
            for f in schema.fields
            if actual.get(f.name) != f.dataType
        ]
        if wrong:
            raise ContractError("schema mismatch: " + "; ".join(wrong))
    return frame


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def null_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, null_count)`` from one aggregate pass."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_count")


def bound_report(frame: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """``(column_name, below, above)``: rows outside the inclusive bounds, one pass."""
    cells = []
    for c, (lo, hi) in bounds.items():
        below = F.count_if(F.col(c) < lo) if lo is not None else F.lit(0).cast("bigint")
        above = F.count_if(F.col(c) > hi) if hi is not None else F.lit(0).cast("bigint")
        cells.append(F.struct(F.lit(c).alias("column_name"), below.alias("below"), above.alias("above")))
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def contract_report(frame: DataFrame, contract: Contract) -> DataFrame:
    """``(rule, subject, violations)`` for the row rules of a contract.

    Null and bound rules share one aggregate; uniqueness is a second one, because
    it needs the keys.
    """
    cells = [
        F.struct(F.lit("non_null").alias("rule"), F.lit(c).alias("subject"), F.count_if(F.col(c).isNull()).alias("violations"))
        for c in contract.non_null
    ]
    for c, (lo, hi) in contract.bounds.items():
        if lo is not None:
            cells.append(
                F.struct(F.lit("minimum").alias("rule"), F.lit(c).alias("subject"), F.count_if(F.col(c) < lo).alias("violations"))
            )
        if hi is not None:
            cells.append(
                F.struct(F.lit("maximum").alias("rule"), F.lit(c).alias("subject"), F.count_if(F.col(c) > hi).alias("violations"))
            )
    parts = []
    if cells:
        parts.append(frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    if contract.unique:
        extra = duplicate_keys(frame, contract.unique).agg(
            F.lit("unique").alias("rule"),
            F.lit(",".join(contract.unique)).alias("subject"),
            F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).cast("bigint").alias("violations"),
        )
        parts.append(extra)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def enforce(frame: DataFrame, contract: Contract, name: str = "table") -> DataFrame:
    """Raise on the first broken rule; the report is a handful of rows."""
    if contract.schema is not None:
        check_structure(frame, contract.schema.names, contract.schema)
    if contract.unique or contract.non_null or contract.bounds:
        broken = contract_report(frame, contract).where("violations > 0").collect()
        if broken:
            raise ContractError(
                f"{name}: " + "; ".join(f"{r['rule']} {r['subject']} ({r['violations']} rows)" for r in broken)
            )
    return frame


def join_keeps_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: would a left join on ``keys`` keep the left row count?"""
    def extra(frame, name):
        return duplicate_keys(frame, keys).agg(
            F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).cast("bigint").alias(name)
        )

    return (
        extra(left, "left_duplicates")
        .crossJoin(extra(right, "right_duplicates"))  # one row each
        .withColumn("keys_unique", (F.col("left_duplicates") == 0) & (F.col("right_duplicates") == 0))
    )


def control_issues(frame: DataFrame, controls: Sequence[str]) -> DataFrame:
    """``(column_name, reason)`` for controls that are absent or have nulls."""
    cells = []
    for c in controls:
        if c not in frame.columns:
            reason = F.lit("missing_column")
        else:
            reason = F.when(F.count_if(F.col(c).isNull()) > 0, F.lit("missing_values"))
        cells.append(F.struct(F.lit(c).alias("column_name"), reason.alias("reason")))
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).where("reason is not null")


def panel_guardrails(
    panel: DataFrame,
    score_columns: Sequence[str],
    key: str = "target_keyword_id",
    rank: str = "serp_rank",
    influential_rate: float | None = None,
    max_influential_rate: float = 0.05,
) -> DataFrame:
    """``(guardrail, value, status)``: rank spread is required, the others warn.

    The value is the smallest population variance over the keywords; a keyword
    without any score counts as 0.
    """
    def spread(c):
        return F.min(F.coalesce(F.col(f"__v_{c}"), F.lit(0.0)))

    per_key = panel.groupBy(key).agg(*[F.var_pop(F.col(c).cast("double")).alias(f"__v_{c}") for c in (rank, *score_columns)])
    lowest = per_key.agg(
        F.coalesce(spread(rank), F.lit(0.0)).alias("rank_variance"),
        F.coalesce(F.least(*[spread(c) for c in score_columns]) if len(score_columns) > 1 else spread(score_columns[0]), F.lit(0.0)).alias(
            "score_variance"
        ),
    )
    cells = [
        F.struct(
            F.lit("rank_variance_within_keyword").alias("guardrail"),
            F.col("rank_variance").alias("value"),
            F.when(F.col("rank_variance") > 0, "pass").otherwise("hard_fail").alias("status"),
        ),
        F.struct(
            F.lit("score_variance_within_keyword").alias("guardrail"),
            F.col("score_variance").alias("value"),
            F.when(F.col("score_variance") > 0, "pass").otherwise("warn").alias("status"),
        ),
    ]
    if influential_rate is not None:
        cells.append(
            F.struct(
                F.lit("influential_row_rate").alias("guardrail"),
                F.lit(float(influential_rate)).alias("value"),
                F.lit("pass" if influential_rate <= max_influential_rate else "warn").alias("status"),
            )
        )
    return lowest.select(F.inline(F.array(*cells)))


def schema_versions(frame: DataFrame, expected: str, column: str = "schema_version") -> DataFrame:
    """``(schema_version, row_count, stale)`` per stored version."""
    return (
        frame.groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("stale", ~F.col(column).eqNullSafe(F.lit(expected)))
    )


def is_current(frame: DataFrame, expected: str, column: str = "schema_version") -> bool:
    return frame.where(~F.col(column).eqNullSafe(F.lit(expected))).isEmpty()


def metric_coverage(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, row_count, non_null_count, null_count)`` in one pass."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count(F.col(c)).alias("non_null_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
        )
        for c in columns
    ]
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
