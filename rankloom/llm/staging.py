"""Intermediate tables in the shared folder, and keys for rows without a usable id."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import ensure_checkpoint_dir

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, limit: int | None) -> Iterator[None]:
    """While this lasts, a batch of rows that goes to a Python worker ends at so many bytes, if a limit is given."""
    before = spark.conf.get(BATCH_CONF, None)
    if limit is not None:
        spark.conf.set(BATCH_CONF, limit)
    try:
        yield
    finally:
        if limit is not None:
            spark.conf.set(BATCH_CONF, before) if before is not None else spark.conf.unset(BATCH_CONF)


def stored(frame: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``frame`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage and outlives any executor.  The shuffle files of what has been written
    are of no more use; Spark removes them once the driver's garbage is collected, which
    happens here instead of by chance.  ``discarded`` removes the table itself.
    """
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with arrow_batches(spark, batch_bytes):
        frame.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(frame.schema).parquet(path)
    out.staged_at = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row by content: equal rows share it and get equal results; nulls are a value of their own."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), text), F.lit("null"))))
