"""Versioned tables: whole versions for every reader, whatever writers do."""

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from rankloom.operators.quality import Contract, ContractError
from rankloom.sources import lake, sinks, versions


def rows(spark, writer, n):
    return spark.range(0, n, 1, 4).select(F.col("id").alias("serp_rank"), F.lit(writer).alias("writer"))


def seen(spark, root):
    schema = rows(spark, "a", 1).schema
    return {r["writer"]: r["n"] for r in lake.scan_table(spark, root, "t", schema).groupBy("writer").agg(F.count("*").alias("n")).collect()}


def test_two_writers_and_a_reader(spark, tmp_path):
    """A reader meets whole versions only; no rows of two writers at once, no table gone in between."""
    root, found, errors = str(tmp_path), [], []
    sinks.write_table(rows(spark, "first", 10), root, "t", keep=20)
    at_work = threading.Event()

    def write(writer, n):
        try:
            for _ in range(4):
                got = sinks.write_table(rows(spark, writer, n), root, "t", Contract(unique=("serp_rank",)), keep=20)
                assert {r["writer"] for r in got.collect()} == {writer} and got.count() == n
        except BaseException as error:  # shown by the main thread
            errors.append(error)

    def read():
        try:
            while not at_work.is_set():
                found.append(seen(spark, root))
        except BaseException as error:
            errors.append(error)

    writers = [threading.Thread(target=write, args=a) for a in (("a", 300), ("b", 700))]
    reader = threading.Thread(target=read)
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    at_work.set()
    reader.join()
    assert not errors
    whole = [{"first": 10}, {"a": 300}, {"b": 700}]
    assert found and all(f in whole for f in found)
    assert seen(spark, root) in whole[1:] and len(versions.history(spark, f"{root}/t")) == 9


def test_same_number_twice(spark, tmp_path):
    """Writers that saw the same last commit both succeed; all readers agree on the order."""
    table = str(tmp_path / "t")
    os.makedirs(f"{table}/commits")
    for name in ("000000000000-aa", "000000000001-cc", "000000000001-bb"):
        open(f"{table}/commits/{name}", "w").close()
    assert versions.current(spark, table) == f"{table}/versions/cc"
    versions.commit(spark, table, f"{table}/versions/00", keep=2)
    assert versions.history(spark, table) == [f"{table}/versions/cc", f"{table}/versions/00"]


def test_failures_and_removal(spark, tmp_path):
    root, table = str(tmp_path), str(tmp_path / "t")
    assert versions.current(spark, table) is None
    with pytest.raises(ContractError):
        sinks.write_table(rows(spark, "a", 5).unionByName(rows(spark, "a", 5)), root, "t", Contract(unique=("serp_rank",)))
    with pytest.raises(lake.MissingTable):
        lake.scan_table(spark, root, "t")
    earlier = sinks.write_table(rows(spark, "a", 5), root, "t")
    sinks.write_table(rows(spark, "b", 0), root, "t")
    assert seen(spark, root) == {} and earlier.count() == 5  # an empty version counts; the one before stays readable
    # A write that breaks off leaves the table as it was and nothing behind.
    broken = rows(spark, "c", 5).withColumn("writer", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        sinks.write_table(broken, root, "t")
    assert seen(spark, root) == {} and len(os.listdir(f"{table}/versions")) == 2
    for n in (1, 2, 3):
        sinks.write_table(rows(spark, "d", n), root, "t")
    assert seen(spark, root) == {"d": 3} and len(os.listdir(f"{table}/versions")) == versions.KEEP
    # What a lost driver left behind goes once it is old enough; named versions stay.
    os.makedirs(f"{table}/versions/left")
    assert versions.vacuum(spark, table) == 0 and versions.vacuum(spark, table, 0) == 1
    assert seen(spark, root) == {"d": 3} and len(os.listdir(f"{table}/versions")) == versions.KEEP


def test_plain_folders_are_read_as_they_are(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows(spark, "a", 7).write.parquet(f"{root}/t")
    assert seen(spark, root) == {"a": 7}
    sinks.write_table(rows(spark, "b", 3), root, "t")
    assert seen(spark, root) == {"b": 3}
