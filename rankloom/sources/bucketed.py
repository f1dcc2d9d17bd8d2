"""The raw lake in hash buckets: batches are appended as deltas, and only touched buckets are ever rewritten.

    root/buckets=N/delta/batch=G/endpoint=E/bucket=B     one folder per batch, append only
    root/buckets=N/base/version=V/endpoint=E/bucket=B    compacted: one row per key

The key of a record (``record_key``, ``record_scope``) is computed once, when it arrives, and
stored; no later step parses a body for it.  A bucket is a hash of the key, so a keyword with a
third of all records is spread like any other.  Choose N so that a bucket is a gigabyte or two.

Batches are ordered by their generation.  Of the rows of a key the last one wins that came with
``new_wins``; without any, the first one.  A compacted row keeps its generation and its mode,
so resolving rows again changes nothing: a batch may be repeated after a failure (it replaces
its own folder), and a compaction may stop anywhere.  A folder counts once Spark has put its
``_SUCCESS`` file there.  Several readers and writers of batches are fine; compact from one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from rankloom import schemas as S
from rankloom.operators.groups import first_per_key
from rankloom.operators.merge import RECORD_KEY, with_record_key

BUCKETS = 64


def _stored_schema(folder: str) -> StructType:
    out = StructType(list(S.RAW.fields)).add("record_key", StringType()).add("record_scope", StringType())
    return out.add("new_wins", BooleanType()).add("generation", LongType()).add("bucket", IntegerType()).add(folder, LongType())


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    files, hadoop = _file_system(spark, path)
    if not files.exists(hadoop):
        return []
    names = [status.getPath().getName() for status in files.listStatus(hadoop)]
    return sorted(n for n in names if n.startswith(prefix))


def _committed(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Complete folders only."""
    found = []
    for name in _children(spark, path, prefix):
        files, marker = _file_system(spark, f"{path}/{name}/_SUCCESS")
        if files.exists(marker):
            found.append(name)
    return found


def _removed(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        files, hadoop = _file_system(spark, path)
        files.delete(hadoop, True)


def _home(spark: SparkSession, root: str, buckets: int) -> str:
    others = [n for n in _children(spark, root, "buckets=") if n != f"buckets={buckets}"]
    if others:
        raise ValueError(f"the lake at {root} has {others[0]}, not buckets={buckets}")
    return f"{root}/buckets={buckets}"


def _read(spark: SparkSession, home: str, kind: str, folder: str, names: Sequence[str]) -> DataFrame:
    schema = _stored_schema(folder)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{home}/{kind}").parquet(*[f"{home}/{kind}/{n}" for n in names])


def _part() -> Column:
    """Endpoint and bucket; both are partition columns, so a filter on it prunes folders."""
    return F.concat_ws("/", "endpoint", F.col("bucket").cast("string"))


def _live(spark: SparkSession, home: str, only: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, list[str], list[str], list[str]]:
    """Current base rows, delta rows, parts with deltas, and the delta and base folders they were read from."""
    batches, versions = _committed(spark, f"{home}/delta", "batch="), _committed(spark, f"{home}/base", "version=")
    delta, base = _read(spark, home, "delta", "batch", batches), _read(spark, home, "base", "version", versions)
    if only is not None:
        delta, base = delta.where(_part().isin(*only)), base.where(_part().isin(*only))
    # Listings of partition values: as many rows as there are folders.
    dirty = sorted(r[0] for r in delta.select(_part()).distinct().collect())
    newest = base.groupBy(_part().alias("part")).agg(F.max("version").alias("version")).collect()
    current = [f"{r['version']}/{r['part']}" for r in newest]
    base = base.where(F.concat_ws("/", F.col("version").cast("string"), _part()).isin(*current))
    return base, delta, dirty, [f"{home}/delta/{n}" for n in batches], [f"{home}/base/{n}" for n in versions]


def _resolved(rows: DataFrame) -> DataFrame:
    newest = F.when(F.col("new_wins"), F.col("generation"))
    return first_per_key(rows, list(RECORD_KEY), [newest.desc_nulls_last(), F.col("generation").asc()])


def _columns(frame: DataFrame) -> DataFrame:
    return frame.select(*S.RAW.names, "record_key", "record_scope", "new_wins", "generation", "bucket")


def _written(frame: DataFrame, path: str) -> None:
    """One folder per (endpoint, bucket), rows sorted by key; a large bucket is split over tasks."""
    (
        frame.hint("rebalance", "endpoint", "bucket")
        .sortWithinPartitions("endpoint", "bucket", "record_key", "record_scope")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "zstd")
        .partitionBy("endpoint", "bucket")
        .parquet(path)
    )


def keyed_batch(batch: DataFrame, buckets: int = BUCKETS, new_wins: bool = True) -> DataFrame:
    """The batch with key columns and bucket, one row per key: its last by (timestamp, response id) if
    new rows win, else its first."""
    rows = with_record_key(batch.select(*S.RAW.names))
    order = [F.col(c).desc() if new_wins else F.col(c).asc() for c in ("timestamp", "response_id")]
    bucket = F.pmod(F.xxhash64("record_key", "record_scope"), F.lit(buckets)).cast("int")
    return first_per_key(rows, list(RECORD_KEY), order).withColumn("bucket", bucket)


def next_generation(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int:
    """One more than any generation in the lake."""
    home = _home(spark, root, buckets)
    batches = [int(n.partition("=")[2]) for n in _children(spark, f"{home}/delta", "batch=")]
    base = _read(spark, home, "base", "version", _committed(spark, f"{home}/base", "version="))
    return 1 + max([-1, *batches, base.agg(F.coalesce(F.max("generation"), F.lit(-1))).first()[0]])


def append(spark: SparkSession, batch: DataFrame, root: str, generation: int, new_wins: bool = True, buckets: int = BUCKETS) -> None:
    """Add a batch; nothing that is stored is read or rewritten.  Appending a generation again replaces it."""
    home = _home(spark, root, buckets)
    rows = keyed_batch(batch, buckets, new_wins).withColumns({"generation": F.lit(generation).cast("bigint"), "new_wins": F.lit(new_wins)})
    _written(_columns(rows), f"{home}/delta/batch={generation}")


def replay(spark: SparkSession, batch: DataFrame, root: str, generation: int, keep_expansion: bool = True, buckets: int = BUCKETS) -> None:
    """Add the rows of ``batch`` whose body differs from the stored one or whose key is new.

    Only the hashes of the bodies in the touched buckets are read.  With ``keep_expansion``
    rebuilt keyword lists are ignored.
    """
    home = _home(spark, root, buckets)
    if keep_expansion:
        batch = batch.where(F.col("endpoint") != "keyword_expansion")
    rows = keyed_batch(batch, buckets)
    touched = [r[0] for r in rows.select(_part()).distinct().collect()]  # at most endpoints times buckets
    known = scan(spark, root, buckets, only=touched, keyed=True).select(*RECORD_KEY, F.col("sha256").alias("__stored"), F.lit(True).alias("__known"))
    changed = rows.join(known, list(RECORD_KEY), "left").where(F.col("__known").isNull() | ~F.col("sha256").eqNullSafe(F.col("__stored")))
    rows = changed.withColumns({"generation": F.lit(generation).cast("bigint"), "new_wins": F.lit(True)})
    _written(_columns(rows), f"{home}/delta/batch={generation}")


def scan(spark: SparkSession, root: str, buckets: int = BUCKETS, only: Sequence[str] | None = None, keyed: bool = False) -> DataFrame:
    """The lake's records, one per key; with ``keyed`` the key columns, generation and bucket too.

    Buckets without deltas are read as they are; rows are compared only in the others.
    ``only`` limits the parts (``endpoint/bucket``) that are read.
    """
    base, delta, dirty, _, _ = _live(spark, _home(spark, root, buckets), only)
    rows = _columns(base.where(~_part().isin(*dirty)))
    if dirty:
        rows = rows.unionByName(_resolved(_columns(base.where(_part().isin(*dirty))).unionByName(_columns(delta))))
    return rows if keyed else rows.select(*S.RAW.names)


def compact(spark: SparkSession, root: str, buckets: int = BUCKETS) -> list[str]:
    """Fold all deltas into the base; returns the parts (``endpoint/bucket``) that were rewritten.

    Other parts stay in their version.  The new version is complete before deltas and replaced
    versions go; until then readers resolve both to the same rows.
    """
    home = _home(spark, root, buckets)
    base, delta, dirty, batches, versions = _live(spark, home)
    if dirty:
        merged = _resolved(_columns(base.where(_part().isin(*dirty))).unionByName(_columns(delta)))
        number = 1 + max([-1, *[int(n.partition("=")[2]) for n in _children(spark, f"{home}/base", "version=")]])
        _written(merged, f"{home}/base/version={number}")
        _removed(spark, _replaced(spark, home, dirty, versions))
    _removed(spark, batches)
    return dirty


def _replaced(spark: SparkSession, home: str, parts: Sequence[str], versions: Sequence[str]) -> list[str]:
    """Folders of older versions that hold the parts."""
    out = []
    for version in versions:
        for endpoint in _children(spark, version, "endpoint="):
            held = _children(spark, f"{version}/{endpoint}", "bucket=")
            out += [f"{version}/{endpoint}/{b}" for b in held if f"{endpoint.partition('=')[2]}/{b.partition('=')[2]}" in set(parts)]
    return out
