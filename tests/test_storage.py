"""Lake storage, publishing and incremental ingest."""

import tempfile

import pytest
from pyspark.sql import functions as F

from rankloom import schemas as S
from rankloom.operators.merge import build_records, upsert, with_record_key
from rankloom.operators.quality import Contract, ContractError
from rankloom.sources import bucketed, lake, sinks
from rankloom.streaming.ingest import ingest, upsert_batch


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def records(spark, endpoint, rows):
    frame = spark.createDataFrame(rows, "target_keyword string, timestamp string, body_json string, metadata_json string")
    return build_records(frame, "run", endpoint, "p")


def first_batch(spark):
    serp = records(spark, "serp", [("a", "1", '{"v":1}', "{}"), ("B", "1", '{"v":1}', "{}")])
    ents = records(spark, "entities", [("a", "1", '{"v":1}', '{"url":"https://x/?utm_a=1"}')])
    return serp.unionByName(ents)


def second_batch(spark):
    return records(spark, "serp", [("b", "2", '{"v":2}', "{}"), ("c", "2", '{"v":3}', "{}")])


def contents(frame):
    return sorted((r["endpoint"], r["target_keyword"], r["sha256"]) for r in frame.collect())


def test_partition_overwrite_and_lookup(spark):
    root = folder()
    sinks.write_raw(first_batch(spark), root)
    sinks.write_raw(second_batch(spark), root)
    raw = lake.scan_raw(spark, root)
    assert raw.columns == S.RAW.names or set(raw.columns) == set(S.RAW.names)
    assert lake.endpoint_rows(raw, "serp").count() == 2 and lake.endpoint_rows(raw, "entities").count() == 1
    known = raw.first()["response_id"]
    assert lake.stored_body(raw, known).count() == 1
    plan = lake.endpoint_rows(raw, "serp")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(endpoint" in plan
    stored = lake.scan_raw(spark, root).select(*S.RAW.names)
    assert sinks.write_raw_changes(stored, stored, root) == 0
    assert [r["endpoint"] for r in sinks.changed_partitions(stored.where("target_keyword <> 'c'"), stored).collect()] == ["serp"]


def test_stream_equals_batch(spark):
    incoming, streamed, batched, checkpoint = folder(), folder(), folder(), folder()
    for batch in (first_batch(spark), second_batch(spark), second_batch(spark)):
        batch.coalesce(1).write.mode("append").parquet(incoming)
        ingest(spark, incoming, streamed, checkpoint, buckets=4).awaitTermination()
        upsert_batch(spark, batch, batched, buckets=4)
    direct = upsert(
        with_record_key(first_batch(spark)), with_record_key(second_batch(spark)), ["endpoint", "record_key", "record_scope"], ["timestamp", "response_id"]
    )
    assert contents(bucketed.scan(spark, streamed, 4)) == contents(bucketed.scan(spark, batched, 4)) == contents(direct)
    assert bucketed.scan(spark, streamed, 4).where("endpoint = 'serp'").count() == 3


def test_failed_check_leaves_the_published_table(spark):
    root = folder()
    good = spark.range(10).select(F.col("id").alias("serp_rank"), F.lit("k").alias("target_keyword_id"))
    sinks.write_table(good, root, "t", Contract(unique=("serp_rank",)))
    with pytest.raises(ContractError):
        sinks.write_table(good.unionByName(good), root, "t", Contract(unique=("serp_rank",)))
    assert lake.scan_table(spark, root, "t", good.schema).count() == 10
    sinks.write_table(good.limit(3), root, "t")
    assert lake.scan_table(spark, root, "t", good.schema).count() == 3
    assert sinks.file_catalog(lake.scan_table(spark, root, "t", good.schema)).agg(F.sum("row_count")).first()[0] == 3


def test_missing_tables(spark):
    root = folder()
    with pytest.raises(lake.MissingTable):
        lake.scan_table(spark, root, "pages")
    assert lake.scan_optional(spark, root, "pages", S.CURATED["pages"]).count() == 0


def test_older_files_get_null_columns(spark):
    root = folder()
    spark.range(1).select(F.lit("r").alias("run_id"), F.lit("x").alias("response_id")).write.parquet(f"{root}/endpoint=serp")
    row = lake.scan_raw(spark, root).first()
    assert (row["endpoint"], row["timestamp"], row["response_body_bytes"]) == ("serp", None, None)


def test_blocklist_file(spark):
    path = f"{folder()}/list.txt"
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("# head\n\n  WWW.Bad.com  # why\nhttps://worse.org/x\nbad.com\n")
    assert sorted(r["domain"] for r in lake.read_blocklist(spark, path).collect()) == ["bad.com", "worse.org"]


def test_result_counts(spark):
    frame = spark.createDataFrame([("e", "m", "significant"), ("f", "m", "underpowered")], "entity_id string, metric string, status string")
    assert {r["status"]: r["row_count"] for r in sinks.write_results(frame, folder()).collect()} == {"significant": 1, "underpowered": 1}
