"""Group statistics and ordering that hold up when one group is a third of the data.

A window over a key sends each key to one task.  Statistics are therefore
aggregated (partial sums before the shuffle) and joined back, and an exact rank
inside an oversized group is taken from a range partitioning of that group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import cut_lineage

# Rows of one group that a single task sorts without trouble.
GROUP_ROWS_PER_TASK = 4_000_000
# Rows of an aggregate that every task may hold.
LOOKUP_ROWS = 100_000


def attach_group_stats(frame: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Each row plus the aggregates of its group.

    Null keys form a group, as in a window.  The join side is the aggregate; its
    strategy is left to the optimizer, which knows the size at run time and
    splits skewed keys.
    """
    if not keys:
        return frame.crossJoin(F.broadcast(frame.agg(*aggregates)))  # exactly one row
    stats = frame.groupBy(*keys).agg(*aggregates)
    added = [c for c in stats.columns if c not in keys]
    return join_null_safe(frame, stats, keys, "left").select(*frame.columns, *added)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null equals null; the right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        part = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = part if i == 0 else condition & part
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def join_measured(frame: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Join to an aggregate whose size only its rows tell: written once and counted, it is broadcast if small.

    Estimates take an aggregate for as large as its input, and the rows of ``frame`` would be shuffled by
    keys of which there may be few.
    """
    lookup = cut_lineage(lookup)
    return frame.join(F.broadcast(lookup) if lookup.count() <= rows else lookup, list(keys), how)


def oversized_groups(frame: DataFrame, keys: Sequence[str], limit: int = GROUP_ROWS_PER_TASK) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > limit)


def _measured_groups(frame: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys of the oversized groups, or None.  There are at most rows / limit of them, so they are broadcast: a
    join that shuffles by these very keys would bring a whole group into one task."""
    hot = cut_lineage(oversized_groups(frame, keys, limit).select(*keys))
    count = hot.count()
    if not count:
        return None
    return F.broadcast(hot) if count <= LOOKUP_ROWS else hot


def group_running(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    limit: int | None = GROUP_ROWS_PER_TASK,
    kind: str = "sum",
) -> DataFrame:
    """Exact running sum or minimum of ``value`` within ``keys``, whatever the group size.

    Ordinary groups use a window.  Rows of oversized groups are range-partitioned
    by (keys, order), so a group spreads over many tasks; each running value is the
    one within its slice combined with the totals of the earlier slices.  ``order``
    must be total for a reproducible result.  ``limit=None`` states that groups are
    bounded.
    """
    total = {"sum": F.sum, "min": F.min}[kind]

    def running(*partition: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(*order)
        return total(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    if limit is None:
        return frame.withColumn(out, running(*keys))
    hot = _measured_groups(frame, keys, limit)
    if hot is None:
        return frame.withColumn(out, running(*keys))
    ordinary = join_null_safe(frame, hot, keys, "left_anti").withColumn(out, running(*keys))

    spread = join_null_safe(frame, hot, keys, "left_semi").repartitionByRange(*[F.col(k) for k in keys], *order)
    # The slice number is part of the written rows: recomputing a lost partition
    # with other range bounds cannot change it.
    sliced = cut_lineage(spread.withColumn("__slice", F.spark_partition_id()))
    totals = sliced.groupBy(*keys, "__slice").agg(total(value).alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", total("__total").over(earlier)).drop("__total")
    local = sliced.withColumn("__local", running(*keys, "__slice"))
    # A row per group and slice: small next to the rows, which would otherwise be shuffled by slice once more.
    offsets = cut_lineage(offsets)
    if offsets.count() <= LOOKUP_ROWS:
        offsets = F.broadcast(offsets)
    joined = join_null_safe(local, offsets, [*keys, "__slice"], "left")
    if kind == "sum":
        combined = F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))
    else:
        combined = F.least("__local", "__before")  # skips nulls
    summed = joined.withColumn(out, combined)
    return ordinary.select(*frame.columns, out).unionByName(summed.select(*frame.columns, out))


def group_row_number(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "row_number",
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Exact ``row_number()`` within ``keys``, safe for oversized groups."""
    return group_running(frame, keys, order, F.lit(1).cast("bigint"), out, limit)


def first_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.

    The ``= 1`` filter lets Spark keep only one row per key and task before the
    shuffle, so hot keys do not travel.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def top_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their number; pruned before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(out, F.row_number().over(window).cast("bigint")).where(F.col(out) <= k)


def sorted_positions(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """``(keys, value, __n, __first, __last)``: zero-based positions of each distinct value.

    Added names are reserved ones: a column to rank may itself be called ``n``.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    running = group_running(counts, keys, [F.col(value).asc()], F.col("__c"), "__upto", limit)
    with_n = attach_group_stats(running, keys, [F.sum("__c").alias("__n")])
    return with_n.select(
        *keys, value, "__n", (F.col("__upto") - F.col("__c")).alias("__first"), (F.col("__upto") - 1).alias("__last")
    )


def group_percentiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: dict[str, float],
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column per share.

    ``percentile`` keeps all distinct values of a group in one buffer.  It serves
    ordinary groups; oversized groups are answered from the sorted positions of
    their values, which are spread over many tasks.
    """
    x = F.col(value).cast("double")

    def direct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.percentile(x, F.lit(s)).alias(n) for n, s in shares.items()])

    if limit is None:
        return direct(frame)
    hot = _measured_groups(frame, keys, limit)
    if hot is None:
        return direct(frame)
    positions = sorted_positions(join_null_safe(frame, hot, keys, "left_semi"), keys, value, limit)

    def value_at(index: Column) -> Column:
        return F.max(F.when((F.col("__first") <= index) & (F.col("__last") >= index), F.col(value).cast("double")))

    cells = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("__n") - 1)
        cells += [
            value_at(F.floor(place)).alias(f"__lo_{name}"),
            value_at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__f_{name}"),
        ]
    wide = positions.groupBy(*keys).agg(*cells)
    picked = wide.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n in shares
        ],
    )
    found = join_null_safe(hot, picked, keys, "left").select(*keys, *shares)
    return direct(join_null_safe(frame, hot, keys, "left_anti")).unionByName(found)


def group_medians(
    frame: DataFrame,
    keys: Sequence[str],
    medians: Sequence[str],
    means: Sequence[str] = (),
    limit: int | None = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Medians and means of several columns per group.

    All groups below the limit are served by one aggregate; the medians of larger
    ones come from :func:`group_percentiles`, column by column.
    """

    def direct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[F.median(F.col(c).cast("double")).alias(c) for c in medians],
            *[F.avg(F.col(c).cast("double")).alias(c) for c in means],
        )

    hot = None if limit is None else _measured_groups(frame, keys, limit)
    if hot is None:
        return direct(frame)
    rows = join_null_safe(frame, hot, keys, "left_semi")
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in means]
    )
    for c in medians:
        found = join_null_safe(found, group_percentiles(rows, keys, c, {f"__m_{c}": 0.5}, limit), keys, "left")
    found = found.select(*keys, *[F.col(f"__m_{c}").alias(c) for c in medians], *means)
    return direct(join_null_safe(frame, hot, keys, "left_anti")).unionByName(found)
