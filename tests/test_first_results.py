"""The first result of a response, whether it is a successful empty one, and its URL, on odd bodies."""

import json

from pyspark.sql import functions as F

from rankloom.functions import variant as V
from rankloom.operators import drift, signals
from rankloom.operators.curate import response_url

RESULTS = ["missing", None, [], {}, "x", 5, [None], [[]], ["x"], [{}], [{"target": "t", "backlinks": 1}, {"target": "u"}], [{"target": " "}], [[{"target": "no"}]]]
TASKS = [{"tasks": x} for x in (None, [], {}, "x", [None], ["x"], [[]], [5, {"result": []}])] + [{}, [], "x", None, 7]


def bodies():
    out = list(TASKS)
    for result in RESULTS:
        for more in ({}, {"status_code": 20000}, {"status_code": 40501}, {"status_code": "20000"}, {"result_count": 0}, {"result_count": 3}, {"result_count": None}, {"url": "https://t/"}):
            task = dict(more) if result == "missing" else {**more, "result": result}
            out += [{"tasks": [task, {"result": [{"target": "second"}]}]}, {"status_code": 50000, "url": "https://b/", "tasks": [task]}]
    return out


def first(values):
    return values[0] if isinstance(values, list) and values else None


def task_of(body):
    return first(body.get("tasks")) if isinstance(body, dict) else None


def result_of(body):
    task = task_of(body)
    result = first(task.get("result")) if isinstance(task, dict) else None
    return result if isinstance(result, dict) else None


def empty(body):
    task = task_of(body)
    if not isinstance(task, dict):
        return False
    ok = lambda node: not isinstance(node.get("status_code"), int) or node["status_code"] in (200, 20000)
    result, count = task.get("result"), task.get("result_count")
    return ok(body) and ok(task) and (result == [] or result is None and count in (None, 0))


def url(body):
    task, result = task_of(body), result_of(body)
    target = result.get("target") if result else None
    named = [x.get("url") for x in (body, task) if isinstance(x, dict)] + [target if target and target.strip() else None]
    return next((x for x in named if isinstance(x, str)), None)


def test_first_result_of_odd_bodies(spark):
    texts = [json.dumps(b) for b in bodies()]
    body = V.parse_body(F.col("text"), binary=False)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", body.alias("body"))
    got = frame.select("text", F.to_json(drift.single_result(F.col("body"))).alias("r"), drift.successful_empty(F.col("body")).alias("e"), response_url(F.col("body")).alias("u")).collect()
    for row, b in zip(got, bodies()):
        assert (json.loads(row.r) if row.r else None, row.e, row.u) == (result_of(b), empty(b), url(b)), row.text


def test_fields_of_a_response_are_made_once(spark):
    columns = "run_id string, response_id string, timestamp string, target_keyword string, endpoint string, request_metadata_json string, response_body_bytes binary"
    raw = spark.createDataFrame([], columns)
    plan = signals.backlinks(raw)._jdf.queryExecution().optimizedPlan().toString()
    # One test for emptiness mentions the field four times.
    assert plan.count("$.result_count") == 4
