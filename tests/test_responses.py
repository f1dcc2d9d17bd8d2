"""JSON strictness and curation on small bodies."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom import schemas as S
from rankloom.functions import variant as V
from rankloom.operators import curate, drift, merge, quality, signals
from rankloom.operators.merge import build_records
from rankloom.sources import lake


def records(spark, endpoint, bodies, meta=None):
    rows = [(f"k{i % 2}", f"2024-01-{i + 1:02d}", json.dumps(b) if not isinstance(b, str) else b, json.dumps(meta[i] if meta else {})) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "target_keyword string, timestamp string, body_json string, metadata_json string")
    return build_records(frame, "run", endpoint, "p")


def result(*items, **extra):
    return {"tasks": [{"result": [{"items": list(items), **extra}]}]}


def test_twenty_organic_rows_and_a_boolean_rank(spark):
    items = [{"type": "organic", "rank_group": i, "url": f"u{i}", "title": "t", "description": 5} for i in range(1, 26)]
    items.insert(3, {"type": "organic", "rank_group": True, "url": "b", "title": "t"})
    items.insert(5, "junk")
    out = curate.serp_items(records(spark, "serp", [result(*items)]), 20)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in S.CURATED["serp_items"]]
    assert [r["serp_rank"] for r in out.orderBy("serp_rank").collect()] == list(range(1, 21))


def test_broken_and_empty_bodies_give_no_rows(spark):
    raw = records(spark, "serp", [{"tasks": None}, {"tasks": [{"result": None}]}, {"tasks": [1, {"result": [2]}]}, {}])
    assert curate.serp_items(raw).count() == 0
    assert [r["usable"] for r in lake.keyword_statuses(raw).collect()] == [False, False]


def test_typed_getters(spark):
    v = F.parse_json(F.lit('{"t":true,"s":"5","f":1.9,"i":7,"n":null,"big":123456789012345678901,"neg":-1.9}'))
    row = spark.range(1).select(
        *[V.integer(v, f"$.{k}").alias(f"i_{k}") for k in "tsfin"],
        V.integer(v, "$.neg").alias("cut"),
        V.strict_integer(v, "$.f").alias("strict"),
        V.boolean(v, "$.t").alias("b"),
        V.boolean(v, "$.i").alias("not_b"),
        V.text(v, "$.i").alias("not_s"),
        V.number(v, "$.big").alias("big"),
    ).first()
    assert (row["i_t"], row["i_s"], row["i_f"], row["i_i"], row["i_n"]) == (None, None, 1, 7, None)
    assert (row["cut"], row["strict"], row["b"], row["not_b"], row["not_s"]) == (-1, None, True, None, None)
    assert row["big"] == pytest.approx(1.2345678901234568e20)


def test_page_text_keeps_source_order(spark):
    content = {"z": {"text": " last first "}, "text": "own", "a": [{"text": "second"}, {"b": {"text": "third"}}], "main_topic": [{"h_title": " "}, {"h_title": " T "}]}
    bodies = [
        result({"url": "https://x/1", "page_content": content, "deep": [{"html": "<p>"}]}),
        {"tasks": [{"result": [{"url": "https://x/2", "text": "direct"}]}]},
        {"tasks": [{"url": "https://x/3", "result": None}]},
        result({"url": "https://x/4", "page_as_markdown": " md "}),
    ]
    got = {r["url"]: (r["title"], r["text"], r["raw_html"]) for r in curate.parsed_pages(records(spark, "page_text", bodies)).collect()}
    assert got == {
        "https://x/1": ("T", "own\n\nlast first\n\nsecond\n\nthird", "<p>"),
        "https://x/2": ("", "direct", ""),
        "https://x/3": ("", "", ""),
        "https://x/4": ("", "md", ""),
    }


def test_passages_number_kept_blocks(spark):
    text = "one two three four five six seven eight nine\n\ntoo short here\n\na b c d e f g h i j k\n\nend"
    pages = curate.pages(records(spark, "page_text", [{"tasks": [{"result": [{"url": "u", "title": "t", "text": text}]}]}]))
    out = curate.passages(pages).collect()
    assert sorted(r["word_count"] for r in out) == [9, 11]
    assert out[0].__fields__ == S.CURATED["passages"].names


def test_flattened_fields_are_pre_order(spark):
    out = curate.page_content_fields(records(spark, "page_text", [result({"url": "u", "b": {"y": [1, None], "x": "é"}, "a": True})])).orderBy("ordinal").collect()
    assert [(r["field_path"].split("items[0].")[1], r["value_type"], r["structured_value"]) for r in out] == [
        ("url", "string", '"u"'),
        ("b", "object", '{"x":"é","y":[1,null]}'),
        ("b.y", "array", "[1,null]"),
        ("b.y[0]", "number", "1"),
        ("b.y[1]", "null", "null"),
        ("b.x", "string", '"é"'),
        ("a", "boolean", "true"),
    ]
    assert [r["ordinal"] for r in out] == list(range(7))


def test_entities_and_metrics(spark):
    body = {"url": "u", "response": {"entities": [
        {"entityId": "e", "matchedText": "E", "confidenceScore": "x", "type": ["T", 3]},
        {"entityId": "e", "matchedText": "E", "confidenceScore": 2},
        {"entityId": 4, "matchedText": "F"}, 7],
        "topics": [], "words": [{"isSense": 0}, {"isSense": "a"}, {"isSense": []}, {"isSense": {"k": 1}}, 5]}}
    raw = records(spark, "entities", [body])
    rows = curate.entities(raw).collect()
    assert [(r["entity_id"], r["confidence"], r["types"]) for r in rows] == [("e", 0.0, ["T"])]
    m = curate.page_metrics(raw).first()
    assert m["textrazor_entity_confidence_score"] == 2.0
    assert (m["textrazor_topic_score"], m["textrazor_category_score"]) == (0.0, None)
    assert (m["textrazor_word_count"], m["textrazor_sense_count"], m["textrazor_relation_count"]) == (4, 2, None)
    assert m["textrazor_topics_present"] and not m["textrazor_page_metrics_complete"]


def test_backlinks_shapes(spark):
    ok = {"target": "t", "backlinks": 5, "referring_domains": 2, "info": {"target_spam_score": 9}, "referring_links_tld": {"z": 1.50, "a": "é"}}
    bodies = [
        {"url": "u0", "tasks": [{"result": [ok]}]},
        {"url": "u1", "tasks": [{"result": [{"total_count": 7}]}]},
        {"url": "u2", "tasks": [{"result": None}]},
        {"url": "u3", "tasks": [{"result": [{**ok, "backlinks": True}]}]},
    ]
    out = {r["url"]: r for r in signals.backlinks(records(spark, "backlinks_summary", bodies)).collect()}
    assert set(out) == {"u0", "u1", "u2"}
    assert (out["u0"]["backlinks_count"], out["u0"]["target_spam_score"], out["u0"]["referring_links_tld_json"]) == (5, 9, '{"a":"é","z":1.5}')
    assert (out["u1"]["backlinks_count"], out["u1"]["referring_domains_count"]) == (7, None)
    assert (out["u2"]["backlinks_count"], out["u2"]["referring_domains_count"]) == (0, 0)
    assert [r["column_name"] for r in signals.backlink_problems(records(spark, "backlinks_summary", bodies)).collect()] == ["backlinks"]


def test_drift_names_the_path(spark):
    bodies = [
        result({"type": "organic", "rank_group": 1, "url": "u", "title": "t"}),
        result({"type": "organic", "rank_group": 1.5, "url": "u"}),
        {"tasks": {}},
        "not json",
        result(items_count=0) | {"tasks": [{"result": [{"items": None}]}]},
    ]
    got = {(r["path"], r["actual"]) for r in drift.response_violations(records(spark, "serp", bodies), "serp").collect()}
    assert got == {
        ("tasks[0].result[0].items[0].rank_group", "number"),
        ("tasks[0].result[0].items[0].title", "absent"),
        ("tasks", "object"),
        ("<root>", "not json"),
    }


def test_nested_http_failure_passes(spark):
    body = result({"url": "u", "status_code": 404})
    assert drift.response_violations(records(spark, "page_text", [body]), "page_text").count() == 0


def test_replay_and_upsert(spark):
    stored = spark.createDataFrame([("a", "serp", "1"), ("b", "serp", "1"), ("c", "keyword_expansion", "1")], "k string, endpoint string, body string")
    rebuilt = spark.createDataFrame([("a", "serp", "2"), ("b", "serp", "1"), ("c", "keyword_expansion", "2"), ("d", "serp", "3")], stored.schema)
    assert sorted(map(tuple, merge.merge_replayed(stored, rebuilt, ["k"], "body").collect())) == [
        ("a", "serp", "2"), ("b", "serp", "1"), ("c", "keyword_expansion", "1"), ("d", "serp", "3")]
    assert {r["k"]: r["body"] for r in merge.merge_replayed(stored, rebuilt, ["k"], "body", keep_expansion=False).collect()}["c"] == "2"
    assert {r["k"]: r["body"] for r in merge.upsert(stored, rebuilt, ["k"], ["body"], new_wins=False).collect()} == {"a": "1", "b": "1", "c": "1", "d": "3"}


def test_contracts_raise(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (0, "b")], "serp_rank int, url string")
    for contract in (quality.Contract(unique=("serp_rank",)), quality.Contract(non_null=("url",)), quality.Contract(bounds={"serp_rank": (1, 20)})):
        with pytest.raises(quality.ContractError):
            quality.enforce(frame, contract)
    with pytest.raises(quality.ContractError):
        quality.check_structure(frame, ["missing"])
    with pytest.raises(quality.ContractError):
        quality.enforce(frame, quality.Contract(S.CURATED["pages"]))
    assert quality.depth_bounds({"serp_rank": (1, 20), "x": (0, 9)}, 5) == {"serp_rank": (1, 5), "x": (0, 9)}
