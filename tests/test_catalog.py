"""Catalogs of stored files: digests that add up, and sources."""

from pyspark.sql import functions as F

from rankloom.sources import sinks


def stored(spark, path):
    rows = spark.range(0, 60, 1, 4).select(
        F.concat(F.lit("e"), F.col("id") % 3).alias("endpoint"), F.concat(F.lit("r"), F.col("id") % 7).alias("response_id"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"), F.lit("v1").alias("schema_version"),
    )
    rows = rows.unionByName(rows.where("x = 1")).unionByName(rows.limit(2).withColumn("response_id", F.lit(None).cast("string")))
    rows.write.partitionBy("endpoint").parquet(path)
    return spark.read.parquet(path)


def digest(frame):
    return {tuple(r) for r in frame.select("endpoint", "row_count", "content_xor", "content_sum").collect()}


def test_files_add_up_to_partitions(spark, tmp_path):
    first = stored(spark, str(tmp_path / "first"))
    files = sinks.file_catalog(first, ["endpoint"])
    merged = sinks.merged_catalog(files, ["endpoint"])
    assert files.count() > 3 and merged.agg(F.sum("file_count")).first()[0] == files.count()
    assert digest(merged) == digest(sinks.dataset_catalog(first, ["endpoint"]))
    first.coalesce(1).write.partitionBy("endpoint").parquet(str(tmp_path / "second"))
    second = sinks.merged_catalog(sinks.file_catalog(spark.read.parquet(str(tmp_path / "second")), ["endpoint"]), ["endpoint"])
    assert digest(second) == digest(merged) and second.agg(F.max("file_count")).first()[0] == 1
    whole = sinks.merged_catalog(files).first()
    assert whole["row_count"] == 63 and whole["content_sum"] == merged.agg(F.sum("content_sum")).first()[0]


def test_one_row_more_or_changed_shows(spark, tmp_path):
    first = stored(spark, str(tmp_path / "first"))
    kept = digest(sinks.dataset_catalog(first, ["endpoint"]))
    twice = first.where("endpoint = 'e1' and x = 7")
    assert len(kept ^ digest(sinks.dataset_catalog(first.union(twice).union(twice), ["endpoint"]))) == 2
    changed = first.withColumn("x", F.when(F.col("x") == 7, 8).otherwise(F.col("x")))
    assert [r[0] for r in sinks.changed_partitions(changed, first).collect()] == ["e1"]


def test_a_value_that_moves_between_columns_shows(spark):
    one = spark.createDataFrame([("e", "v", None)], "endpoint string, a string, b string")
    other = spark.createDataFrame([("e", None, "v")], "endpoint string, a string, b string")
    assert sinks.changed_partitions(one, other).count() == 1


def test_sources_and_empty_tables(spark, tmp_path):
    first = stored(spark, str(tmp_path / "first"))
    sources = sinks.source_responses(first, ["endpoint"])
    assert sources.columns == ["endpoint", "file_path", "response_id"] and sources.where("response_id is null").count() == 0
    assert sources.select("endpoint", "response_id").distinct().count() == 21
    first.limit(0).write.parquet(str(tmp_path / "none"))
    none = sinks.file_catalog(spark.read.schema(first.schema).parquet(str(tmp_path / "none")), ["endpoint"])
    assert sinks.merged_catalog(none, ["endpoint"]).count() == 0
    assert tuple(sinks.merged_catalog(none).first()) == (0, 0, None, None)
