"""Writing tables: validated, sorted for retrieval, published by commit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.quality import Contract, enforce
from rankloom.sources import versions

RETRIEVAL_ORDER = (
    "target_keyword_id",
    "canonical_url_hash",
    "serp_rank",
    "serp_item_id",
    "page_id",
    "passage_id",
    "url",
)


def _sorted(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    columns = [c for c in order if c in frame.columns]
    if not columns:
        return frame
    # Range partitions keep neighbouring keys in one file, so min/max statistics prune.
    return frame.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write_table(
    frame: DataFrame,
    root: str,
    name: str,
    contract: Contract | None = None,
    order: Sequence[str] = RETRIEVAL_ORDER,
    keep: int = versions.KEEP,
) -> DataFrame:
    """Replace a table after its rows have passed the contract.

    Rows are written once to a version folder of this writer, checked from there (columnar,
    no recomputation of the plan) and then committed; a failed check or write leaves the
    table as it was.  Returned is what this writer wrote.  Of several writers the last commit
    counts.  Read with :func:`rankloom.sources.lake.scan_table`; frames read before stay valid
    until ``keep`` further commits.
    """
    spark = frame.sparkSession
    table = f"{root}/{name}"
    version = versions.new_version(table)
    try:
        _sorted(frame, order).write.option("compression", "zstd").parquet(version)
        written = spark.read.schema(frame.schema).parquet(version)
        if contract is not None:
            enforce(written, contract, name)
    except BaseException:
        versions.discard(spark, version)
        raise
    versions.commit(spark, table, version, keep)
    return written


def write_raw(frame: DataFrame, root: str) -> None:
    """Replace only the endpoint partitions present in ``frame``."""
    (
        frame.repartitionByRange("endpoint", "target_keyword", "response_id")
        .sortWithinPartitions("endpoint", "target_keyword", "response_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("endpoint")
        .parquet(root)
    )


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of a row; nulls count by their column, so a value that moves to another column changes it."""
    cells = [F.col(f"`{c}`") for c in sorted(columns)]
    return F.xxhash64(*cells, *[c.isNull() for c in cells])


def _digest(columns: Sequence[str]) -> list[Column]:
    """Mergeable digest of a multiset of rows.

    The exclusive or alone is blind to rows stored twice; the sum is not.
    """
    row = row_hash(columns)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(row).alias("content_xor"),
        F.sum(row.cast("decimal(38,0)")).alias("content_sum"),
    ]


def partition_digests(frame: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Row count and order-free content hash per partition; mergeable, so no sort."""
    return frame.groupBy(*keys).agg(*_digest([c for c in frame.columns if c not in keys]))


def changed_partitions(new: DataFrame, stored: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Keys of ``new`` whose rows are not exactly the stored ones."""
    both = partition_digests(new, keys).exceptAll(partition_digests(stored, keys))
    return both.select(*keys).distinct()


def write_raw_changes(new: DataFrame, stored: DataFrame, root: str) -> int:
    """Write only changed endpoint partitions; returns how many."""
    changed = [r["endpoint"] for r in changed_partitions(new, stored).collect()]  # one row per endpoint
    if changed:
        write_raw(new.where(F.col("endpoint").isin(*changed)), root)
    return len(changed)


def dataset_catalog(frame: DataFrame, by: Sequence[str] = (), response: str = "response_id") -> DataFrame:
    """Version, counts, sources and content digest of a dataset, per partition if asked."""
    cells = [F.min("schema_version").alias("schema_version"), *_digest([c for c in frame.columns if c not in by])]
    if response in frame.columns:
        cells.append(F.count_distinct(response).alias("source_response_count"))
    return frame.groupBy(*by).agg(*cells) if by else frame.agg(*cells)


def file_catalog(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """File, row count and content digest of a stored table, read from its files.

    ``by`` names the partition columns.  They are listed and left out of the digest, which
    then adds up to that of :func:`dataset_catalog` (see :func:`merged_catalog`).
    """
    columns = [c for c in frame.columns if c not in by]
    return frame.withColumn("file_path", F.col("_metadata.file_path")).groupBy(*by, "file_path").agg(*_digest(columns))


def merged_catalog(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digest of partitions, or of the whole table, from those of its files.

    It depends on the rows only: the same rows in other files, as after a compaction, give
    the same digest.  Partitions of null form one group.
    """
    cells = [
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.bit_xor("content_xor").alias("content_xor"),
        F.sum("content_sum").alias("content_sum"),
    ]
    return files.groupBy(*by).agg(*cells) if by else files.agg(*cells)


def source_responses(frame: DataFrame, by: Sequence[str] = (), response: str = "response_id") -> DataFrame:
    """``(by, file_path, response)``: which stored responses a file's rows come from, one row each.

    A table instead of a list per file, so that a file of many sources stays many rows.
    Rows without a source are left out.
    """
    named = frame.select(*by, F.col("_metadata.file_path").alias("file_path"), response)
    return named.where(F.col(response).isNotNull()).distinct()


def write_results(results: DataFrame, root: str, name: str = "entity_results", status: str = "status") -> DataFrame:
    """Write a result table and return its status counts."""
    written = write_table(results, root, name, order=[c for c in ("metric", "entity_id") if c in results.columns])
    return written.groupBy(status).agg(F.count(F.lit(1)).alias("row_count"))
