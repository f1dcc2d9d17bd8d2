"""Stored bodies are read in one walk (F12, F13, F14, F16), with the results of the level-by-level reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import variant as V
from rankloom.functions.text import canonical_url
from rankloom.operators import curate, drift

SCALARS = [5, 5.5, "x", True, None, {}, [], {"a": 1}, [1], 10**23, "organic", 20000]
ITEM = "type rank_group url title description onpage_score checks meta total_transfer_size anchor dofollow page_from_rank".split()


def _odd_bodies(count=400):
    rng = random.Random(11)

    def maybe(make, share=0.1):
        return rng.choice(SCALARS) if rng.random() < share else make()

    def item():
        usual = {"type": "organic", "rank_group": 3, "url": "http://u", "title": "t"}
        return {k: usual[k] if k in usual and rng.random() < 0.8 else rng.choice(SCALARS) for k in ITEM if rng.random() < 0.9}

    def level(name, below, own):
        return {**{k: rng.choice(SCALARS) for k in own if rng.random() < 0.7}, **({name: maybe(lambda: [maybe(below) for _ in range(rng.randint(0, 3))])} if rng.random() < 0.9 else {})}

    def body():
        return {"tasks": maybe(lambda: [maybe(lambda: level("result", lambda: level("items", item, ["target", "backlinks"]), ["status_code"])) for _ in range(rng.randint(0, 2))])}

    return [(i, json.dumps(maybe(body, 0.05))) for i in range(count)] + [(count, "{bad")]


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame(_odd_bodies(), "i int, b string").withColumn("body", F.try_parse_json("b"))


@pytest.mark.parametrize("endpoint", [e for e in drift.DECLARED if e not in ("page_text", "onpage_instant_pages")])
def test_one_walk_finds_what_levels_find(bodies, endpoint):
    both = bodies.select(drift.violations(F.col("body"), endpoint).alias("a"), drift._by_level(F.col("body"), endpoint).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    assert any(r.a for r in both)


def test_organic_items_by_plain_python(bodies):
    def expected(text):
        try:
            body = json.loads(text)
        except ValueError:
            return []
        below = lambda node, name: node[name] if isinstance(node, dict) and isinstance(node.get(name), list) else []
        items = [i for t in below(body, "tasks") for r in below(t, "result") for i in below(r, "items") if isinstance(i, dict)]
        whole = lambda v: type(v) is int and abs(v) < 2**63
        good = [i for i in items if i.get("type") == "organic" and whole(i.get("rank_group")) and isinstance(i.get("url"), str) and isinstance(i.get("title"), str)]
        return [(i["rank_group"], i["url"], i["title"], i["description"] if isinstance(i.get("description"), str) else "") for i in good[:2]]

    rows = bodies.select("b", curate.organic_items(F.col("body"), 2).alias("o")).collect()
    found = [[(o.serp_rank, o.url, o.title, o.description) for o in r.o] for r in rows]
    assert found == [expected(r.b) for r in rows]
    assert sum(map(len, found)) > 5


def test_body_is_read_once(bodies):
    """Before, every level was copied and every field of an item looked up on its own."""
    plan = bodies.select(curate.organic_items(F.col("body"), 2).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.tasks") == 1 and "$.rank_group" not in plan


def test_container_checks_copy_nothing(spark):
    rows = spark.createDataFrame([(t,) for t in ("{}", '{"-":"x"}', "[]", "[1,{}]", "1", "null", '"x"', None)], "t string")
    got = rows.select(V.is_object(F.parse_json("t")).alias("o"), V.is_array(F.parse_json("t")).alias("a")).collect()
    assert [(r.o, r.a) for r in got] == [(True, False)] * 2 + [(False, True)] * 2 + [(False, False)] * 4


def test_canonical_urls_with_and_without_queries(spark):
    cases = {
        "HTTP://A.b/c#f": "http://A.b/c",
        "https://a/?utm_source=1&q=2#x": "https://a/?q=2",
        "https://a/?UTM_x=1": "https://a/",
        "https://a/?q=a b&r&%67clid=3&s=%zz": "https://a/?q=a+b&r=&s=%25zz",
        "x?=1&&a=b=c": "x?=1&a=b%3Dc",
        "": "",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", canonical_url("u").alias("c")).collect()
    assert {r.u: r.c for r in rows} == cases
