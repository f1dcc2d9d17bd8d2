"""The bucketed lake: what a batch touches, which row of a key wins, repeated and broken-off work."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from rankloom.operators.merge import build_records
from rankloom.sources import bucketed

BUCKETS = 4


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def records(spark, rows, endpoint="serp"):
    frame = spark.createDataFrame([(k, str(t), f'{{"v":{v}}}', "{}") for k, t, v in rows], "target_keyword string, timestamp string, body_json string, metadata_json string")
    return build_records(frame, "run", endpoint, "p")


def values(frame):
    return {r["target_keyword"]: r["response_body_bytes"].decode() for r in frame.collect()}


def files(root):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/buckets=*/base/**/*.parquet", recursive=True)}


def part_of(path):
    names = dict(x.split("=", 1) for x in path.split("/") if "=" in x)
    return f"{names['endpoint']}/{names['bucket']}"


def test_a_batch_rewrites_only_its_buckets(spark):
    root = folder()
    bucketed.append(spark, records(spark, [(f"k{i}", 1, i) for i in range(200)]), root, 0, buckets=BUCKETS)
    bucketed.append(spark, records(spark, [("other", 1, 1)], "entities"), root, 1, buckets=BUCKETS)
    assert files(root) == {}
    assert len(bucketed.compact(spark, root, BUCKETS)) == BUCKETS + 1
    before = files(root)
    bucketed.append(spark, records(spark, [("k5", 2, -5), ("k6", 2, -6)]), root, 2, buckets=BUCKETS)
    assert files(root) == before
    touched = {r[0] for r in bucketed.keyed_batch(records(spark, [("k5", 2, -5), ("k6", 2, -6)]), BUCKETS).select(bucketed._part()).collect()}
    assert set(bucketed.compact(spark, root, BUCKETS)) == touched and 1 <= len(touched) <= 2
    after = files(root)
    assert {p: t for p, t in before.items() if part_of(p) not in touched} == {p: t for p, t in after.items() if part_of(p) not in touched}
    assert not any(part_of(p) in touched for p in before if p in after)
    got = values(bucketed.scan(spark, root, BUCKETS))
    assert len(got) == 201 and got["k5"] == '{"v":-5}' and got["k7"] == '{"v":7}'


def test_appending_reads_nothing_and_clean_buckets_are_not_compared(spark):
    root = folder()
    bucketed.append(spark, records(spark, [(f"k{i}", 1, i) for i in range(50)]), root, 0, buckets=BUCKETS)
    bucketed.compact(spark, root, BUCKETS)
    plan = bucketed.scan(spark, root, BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "parse_json" not in plan
    only = bucketed.scan(spark, root, BUCKETS, only=["serp/3"], keyed=True)
    assert {r["bucket"] for r in only.collect()} == {3}


def test_random_batches_equal_a_plain_dictionary(spark):
    rng, root, expected = random.Random(3), folder(), {}
    for generation in range(7):
        wins = rng.random() < 0.5
        batch = [(f"k{rng.randrange(15)}", t, 1000 * generation + t) for t in range(12)]
        bucketed.append(spark, records(spark, batch), root, generation, wins, BUCKETS)
        if rng.random() < 0.4:
            bucketed.append(spark, records(spark, batch), root, generation, wins, BUCKETS)
        rows = sorted(batch, key=lambda r: str(r[1]))
        for k in {r[0] for r in batch}:
            mine = [r for r in rows if r[0] == k]
            if wins or k not in expected:
                expected[k] = f'{{"v":{(mine[-1] if wins else mine[0])[2]}}}'
        if generation in (2, 5):
            bucketed.compact(spark, root, BUCKETS)
            bucketed.append(spark, records(spark, batch), root, generation, wins, BUCKETS)  # arrives again after it was folded in
        assert values(bucketed.scan(spark, root, BUCKETS)) == expected
    assert bucketed.next_generation(spark, root, BUCKETS) == 7


def test_broken_off_work_is_not_seen(spark):
    root = folder()
    bucketed.append(spark, records(spark, [("a", 1, 1), ("b", 1, 2)]), root, 0, buckets=BUCKETS)
    bucketed.compact(spark, root, BUCKETS)
    bucketed.append(spark, records(spark, [("a", 2, 9)]), root, 1, buckets=BUCKETS)
    os.remove(f"{root}/buckets={BUCKETS}/delta/batch=1/_SUCCESS")
    assert values(bucketed.scan(spark, root, BUCKETS))["a"] == '{"v":1}'
    bucketed.append(spark, records(spark, [("a", 2, 9)]), root, 1, buckets=BUCKETS)
    half = f"{root}/buckets={BUCKETS}/base/version=7"
    records(spark, [("a", 3, 77)]).withColumns({"record_key": F.lit("a"), "record_scope": F.lit(""), "new_wins": F.lit(True), "generation": F.lit(9), "bucket": F.lit(0)}).write.partitionBy("endpoint", "bucket").parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert values(bucketed.scan(spark, root, BUCKETS)) == {"a": '{"v":9}', "b": '{"v":2}'}
    bucketed.compact(spark, root, BUCKETS)
    assert values(bucketed.scan(spark, root, BUCKETS)) == {"a": '{"v":9}', "b": '{"v":2}'}


def test_replay_adds_only_what_differs(spark):
    root = folder()
    bucketed.append(spark, records(spark, [("a", 1, 1), ("b", 1, 2)]), root, 0, buckets=BUCKETS)
    bucketed.compact(spark, root, BUCKETS)
    bucketed.replay(spark, records(spark, [("a", 5, 1), ("b", 5, 3), ("c", 5, 4)]), root, 1, buckets=BUCKETS)
    assert sorted((r["target_keyword"], r["timestamp"]) for r in bucketed.scan(spark, root, BUCKETS).collect()) == [("a", "1"), ("b", "5"), ("c", "5")]
    bucketed.replay(spark, records(spark, [("x", 6, 1)], "keyword_expansion"), root, 2, buckets=BUCKETS)
    assert "x" not in values(bucketed.scan(spark, root, BUCKETS))
    bucketed.replay(spark, records(spark, [("x", 6, 1)], "keyword_expansion"), root, 3, keep_expansion=False, buckets=BUCKETS)
    assert "x" in values(bucketed.scan(spark, root, BUCKETS))


def test_a_hot_keyword_is_spread_and_bucket_counts_must_agree(spark):
    root = folder()
    frame = spark.createDataFrame([("hot", "1", "{}", f'{{"url":"https://x.org/{i}"}}') for i in range(300)], "target_keyword string, timestamp string, body_json string, metadata_json string")
    bucketed.append(spark, build_records(frame, "run", "page_text", "p"), root, 0, buckets=BUCKETS)
    sizes = [r["count"] for r in bucketed.scan(spark, root, BUCKETS, keyed=True).groupBy("bucket").count().collect()]
    assert len(sizes) == BUCKETS and max(sizes) < 120 and sum(sizes) == 300
    with pytest.raises(ValueError, match="buckets=4"):
        bucketed.scan(spark, root, 16)


def test_nothing(spark):
    root = folder()
    assert bucketed.scan(spark, root, BUCKETS).count() == 0 and bucketed.compact(spark, root, BUCKETS) == []
    bucketed.append(spark, records(spark, [("a", 1, 1)]).where("false"), root, 0, buckets=BUCKETS)
    assert bucketed.scan(spark, root, BUCKETS).count() == 0 and bucketed.compact(spark, root, BUCKETS) == []
