"""Session settings the jobs rely on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that are right on one machine and on a large cluster alike.  Anything
# sized to the cluster (shuffle partitions, memory) is left to spark-submit.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "rankloom") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a single-machine master gets a folder of its own when the setting is
    absent; on a cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(frame):
    """Reliable checkpoint: survives executor loss and fixes what was computed."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def store_columns(frame):
    """:func:`cut_lineage` for wide tables: written as Parquet under the checkpoint folder and read back.

    Columns are compressed, a checkpoint of rows is not.  Shuffle files of what has been written are of no more
    use; Spark removes them once the driver's garbage is collected, which is asked for here.
    """
    if any("void" in kind for _, kind in frame.dtypes):
        return cut_lineage(frame)  # Parquet has no such type
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/columns-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    release_shuffles(spark)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def shared_partitions(spark: SparkSession) -> Iterator[None]:
    """While this lasts, frames dealt out by a part of a join's key are joined as they lie.

    Otherwise Spark shuffles both once more by the whole key.  Only for parts of which no value has many rows.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no frame of the driver needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    target = os.path.join(folder, "rankloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)
