"""Incremental ingest of raw records with an idempotent upsert into the bucketed lake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom import schemas as S
from rankloom.sources import bucketed


def upsert_batch(spark: SparkSession, batch: DataFrame, root: str, new_wins: bool = True, generation: int | None = None, buckets: int = bucketed.BUCKETS) -> int:
    """Append a batch to the lake and return its generation (by default the next one).

    The same records may arrive again after a failure: with the same generation they replace
    themselves, with a later one the key decides, so a repeated batch changes nothing.
    """
    if generation is None:
        generation = bucketed.next_generation(spark, root, buckets)
    bucketed.append(spark, batch, root, generation, new_wins, buckets)
    return generation


def ingest(
    spark: SparkSession,
    incoming: str,
    root: str,
    checkpoint: str,
    new_wins: bool = True,
    on_batch: Callable[[int], None] | None = None,
    buckets: int = bucketed.BUCKETS,
    first_generation: int = 0,
):
    """Process all files under ``incoming`` once and stop; run again for new files.

    A batch's generation is ``first_generation`` plus its number in the stream, which a restart repeats.
    """
    stream = spark.readStream.schema(S.RAW).option("maxFilesPerTrigger", 1000).parquet(incoming)

    def run(batch: DataFrame, epoch: int) -> None:
        upsert_batch(batch.sparkSession, batch, root, new_wins, first_generation + epoch, buckets)
        if on_batch:
            on_batch(epoch)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
