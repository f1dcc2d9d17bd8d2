"""Response drift: declared field types per endpoint against stored bodies.

The declarations are data.  The check is one expression per endpoint that returns
all violations of a body with their exact paths; the caller fails or quarantines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import variant as V
from rankloom.operators.curate import nested_http_failure, open_bodies, usable_organic

# Fixed values: (level, field, allowed JSON types).  Levels: task, result, item.
DECLARED = {
    "keyword_expansion": [("task", "result", "array"), ("result", "keyword", "string")],
    "serp": [
        ("task", "result", "array null"),
        ("result", "items", "array null"),
        ("item", "type", "string"),
        ("item", "rank_group", "integer"),
    ],
    "page_text": [("task", "result", "array null")],
    "onpage_instant_pages": [
        ("task", "result", "array null"),
        ("result", "items", "array"),
        ("item", "url", "string"),
        ("item", "onpage_score", "integer number null"),
        ("item", "page_timing", "object null"),
        ("item", "checks", "object null"),
        ("item", "meta", "object null"),
        ("item", "total_transfer_size", "integer null"),
        ("item", "has_micromarkup", "boolean null"),
        ("item", "has_micromarkup_errors", "boolean null"),
    ],
    "backlinks_summary": [
        ("task", "result", "array null"),
        ("result", "target", "string"),
        ("result", "backlinks", "integer"),
        ("result", "referring_domains", "integer"),
    ],
    "backlinks_dofollow_summary": [
        ("task", "result", "array null"),
        ("result", "target", "string"),
        ("result", "backlinks", "integer"),
    ],
    "backlinks_detail": [
        ("task", "result", "array null"),
        ("result", "target", "string"),
        ("result", "items", "array null"),
        ("item", "domain_from_rank", "integer"),
        ("item", "page_from_rank", "integer"),
        ("item", "backlink_spam_score", "integer"),
        ("item", "anchor", "string null"),
        ("item", "dofollow", "boolean"),
        ("item", "tld_from", "string null"),
        ("item", "domain_from_country", "string null"),
        ("item", "first_seen", "string null"),
    ],
}
BODY_FIELDS = ("page_content", "page_as_markdown", "raw_html", "html", "page_html")
PENDING_FIELDS = ("crawl_status", "crawl_progress", "items", "items_count")

_NONE = "cast(array() as array<struct<path:string,expected:string,actual:string>>)"


def json_type(v: Column) -> Column:
    """array, object, string, integer, number, boolean, null or absent."""
    t = V.type_of(v)  # reached for scalars only
    return (
        F.when(v.isNull(), "absent")
        .when(F.is_variant_null(v), "null")
        .when(V.is_array(v), "array")
        .when(V.is_object(v), "object")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(F.rlike(t, F.lit(V.INTEGER_TYPES)), "integer")
        .otherwise("number")
    )


def _issue(bad: Column, path: Column, expected: str, actual: Column) -> Column:
    entry = F.struct(path.alias("path"), F.lit(expected).alias("expected"), actual.alias("actual"))
    return F.when(bad, F.array(entry)).otherwise(F.expr(_NONE))


def _field(node: Column, prefix: Column, name: str, types: str) -> Column:
    return _typed(V.at(node, f"$.{name}"), F.concat(prefix, F.lit(f".{name}")), types, ["null"] if name == "items" else [])


def _typed(value: Column, path: Column, types: str, also: list[str] = []) -> Column:
    allowed = types.split()
    fine = _fits(value, {*allowed, *also, *(["absent"] if "null" in allowed else [])})
    return _issue(~fine, path, " or ".join(allowed), json_type(value))


def _fits(value: Column, kinds: set[str]) -> Column:
    """Is the value of one of the kinds?  Cheaper than naming its kind."""
    tests = {
        "absent": lambda: value.isNull(),
        "null": lambda: F.coalesce(F.is_variant_null(value), F.lit(False)),
        "array": lambda: V.is_array(value),
        "object": lambda: V.is_object(value),
        "string": lambda: V.is_string(value),
        "boolean": lambda: V.is_boolean(value),
        "integer": lambda: V.is_integer(value),
        "number": lambda: V.is_number(value),
    }
    out = F.lit(False)
    for kind in sorted(kinds):
        out = out | tests[kind]()
    return out


def _children(node: Column, path: Column, name: str, check) -> Column:
    """Concatenated issues of the elements of an array field; non-objects are issues."""
    nodes = V.elements(node, f"$.{name}")

    def one(child, i):
        where = F.concat(path, F.lit(f".{name}["), i.cast("string"), F.lit("]"))
        return F.when(V.is_object(child), check(child, where)).otherwise(
            _issue(F.lit(True), where, "object", json_type(child))
        )

    return F.flatten(F.transform(nodes, one))


def _content_item(item: Column, path: Column, others_have_body: Column) -> Column:
    parts = [
        _field(item, path, "url", "string null"),
        _field(item, path, "page_content", "object null"),
        _field(item, path, "page_as_markdown", "string null"),
        *[_field(item, path, name, "string null") for name in BODY_FIELDS[2:]],
    ]
    bodyless = ~_has_body(item) & ~others_have_body
    pending = F.lit(False)
    for name in PENDING_FIELDS:
        pending = pending | V.has_key(item, f"$.{name}")
    parts.append(_issue(bodyless & ~pending, path, "item with content or html", F.lit("object")))
    return F.concat(*parts)


def _has_body(item: Column) -> Column:
    out = F.lit(False)
    for name in BODY_FIELDS:
        out = out | ~V.is_missing(V.at(item, f"$.{name}"))
    return out


def _content_result(result: Column, path: Column) -> Column:
    direct = ~V.is_missing(V.at(result, "$.text"))
    texts = F.concat(
        *[
            _issue(json_type(V.at(result, f"$.{n}")) != "string", F.concat(path, F.lit(f".{n}")), "string", json_type(V.at(result, f"$.{n}")))
            for n in ("url", "text")
        ],
        _issue(
            ~json_type(V.at(result, "$.title")).isin("string", "absent"),
            F.concat(path, F.lit(".title")),
            "string",
            json_type(V.at(result, "$.title")),
        ),
    )
    items = V.at(result, "$.items")
    nothing = V.is_missing(items) & F.coalesce(V.number(result, "$.items_count") == 0, F.lit(False))
    any_body = F.exists(V.objects(result, "$.items"), _has_body)
    listed = F.when(
        V.is_array(items), _children(result, path, "items", lambda item, p: _content_item(item, p, any_body))
    ).otherwise(_issue(~nothing, F.concat(path, F.lit(".items")), "array", json_type(items)))
    return F.when(direct, texts).otherwise(listed)


def _organic_item(item: Column, path: Column) -> Column:
    organic = F.coalesce(V.text(item, "$.type") == "organic", F.lit(False))
    return F.concat(
        *[
            _issue(
                organic & (json_type(V.at(item, f"$.{n}")) != "string"),
                F.concat(path, F.lit(f".{n}")),
                "string",
                json_type(V.at(item, f"$.{n}")),
            )
            for n in ("url", "title")
        ]
    )


def violations(body: Column, endpoint: str) -> Column:
    """Array of ``(path, expected, actual)`` for one body.

    Bodies whose tasks, results and items are arrays of objects are read in one walk; any other body, and page text,
    is checked level by level.
    """
    if endpoint == "page_text":
        return _by_level(body, endpoint)
    tasks, regular = _regular(body, endpoint)
    found = F.when(regular, _shaped_violations(tasks, endpoint)).otherwise(_by_level(body, endpoint, False))
    return _unless_failed(body, found) if endpoint == "onpage_instant_pages" else found


def _unless_failed(body: Column, found: Column) -> Column:
    # A fetched page may answer 4xx/5xx inside a successful task; its body is bare on purpose.
    return F.when(nested_http_failure(body).isNotNull(), F.expr(_NONE)).otherwise(found)


def _level_fields(endpoint: str) -> dict[str, dict[str, str]]:
    """Declared types of the fields of each level, without the arrays that hold the next level."""
    out: dict[str, dict[str, str]] = {"task": {}, "result": {}}
    for level, name, types in DECLARED[endpoint]:
        out.setdefault(level, {})[name] = types
    del out["task"]["result"]
    if "item" in out:
        out["result"].pop("items", None)
    if endpoint == "serp":
        out["item"].update({"url": "", "title": ""})
    return out


def _regular(body: Column, endpoint: str) -> tuple[Column, Column]:
    """The tasks with their declared fields, and whether every level of them is an array of objects."""
    fields = _level_fields(endpoint)
    tasks = V.shaped_tasks(body, fields)

    def result_fine(result):
        fine = result.isNotNull()
        return fine & F.forall(result["items"], lambda i: i.isNotNull()) if "item" in fields else fine

    regular = F.forall(tasks, lambda t: t.isNotNull() & F.forall(t["result"], result_fine))
    return tasks, F.coalesce(regular, F.lit(False))


def _shaped_violations(tasks: Column, endpoint: str) -> Column:
    """Violations of the fields of regular bodies."""
    fields = _level_fields(endpoint)

    def place(path, name, i):
        return F.concat(path, F.lit(f"{name}["), i.cast("string"), F.lit("]"))

    def own(level, node, path):
        return [_typed(node[name], F.concat(path, F.lit(f".{name}")), types) for name, types in fields[level].items() if types]

    def below(nodes, path, name, check):
        return F.flatten(F.transform(nodes, lambda child, i: check(child, place(path, f".{name}", i))))

    def joined(parts):
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.expr(_NONE)

    def item(node, path):
        organic = F.coalesce(F.try_variant_get(node["type"], "$", "string") == "organic", F.lit(False)) if endpoint == "serp" else None
        texts = ("url", "title") if endpoint == "serp" else ()
        wrong = [
            _issue(~V.is_string(node[n]) & organic, F.concat(path, F.lit(f".{n}")), "string", json_type(node[n])) for n in texts
        ]
        return joined([*own("item", node, path), *wrong])

    def result(node, path):
        return joined([*own("result", node, path), *([below(node["items"], path, "items", item)] if "item" in fields else [])])

    def task(node, path):
        return joined([*own("task", node, path), below(node["result"], path, "result", result)])

    return F.flatten(F.transform(tasks, lambda node, i: task(node, place(F.lit("tasks"), "", i))))


def _by_level(body: Column, endpoint: str, failures: bool = True) -> Column:
    """Violations of any body, each level read from the one above."""
    fields = DECLARED[endpoint]

    def at_level(level, node, path):
        checks = [_field(node, path, name, types) for lv, name, types in fields if lv == level]
        return F.concat(*checks) if checks else F.expr(_NONE)

    deep = any(lv == "item" for lv, _, _ in fields)

    def check_item(item, path):
        found = at_level("item", item, path)
        return F.concat(found, _organic_item(item, path)) if endpoint == "serp" else found

    def check_result(result, path):
        if endpoint == "page_text":
            return _content_result(result, path)
        found = at_level("result", result, path)
        return F.concat(found, _children(result, path, "items", check_item)) if deep else found

    def check_task(task, path):
        return F.concat(at_level("task", task, path), _children(task, path, "result", check_result))

    tasks = V.at(body, "$.tasks")
    root = F.lit("tasks")

    def numbered(task, i):
        where = F.concat(root, F.lit("["), i.cast("string"), F.lit("]"))
        return F.when(V.is_object(task), check_task(task, where)).otherwise(
            _issue(F.lit(True), where, "object", json_type(task))
        )

    inner = F.when(V.is_array(tasks), F.flatten(F.transform(V.elements(body, "$.tasks"), numbered))).otherwise(
        _issue(F.lit(True), root, "array", json_type(tasks))
    )
    out = F.when(V.is_object(body), inner).otherwise(
        _issue(F.lit(True), F.lit("<root>"), "object", F.when(body.isNull(), "not json").otherwise(json_type(body)))
    )
    return _unless_failed(body, out) if failures and endpoint in ("page_text", "onpage_instant_pages") else out


def response_violations(raw: DataFrame, endpoint: str) -> DataFrame:
    return open_bodies(raw, endpoint).select(
        "run_id", "endpoint", "response_id", F.inline(violations(F.col("body"), endpoint))
    )


def record_violations(raw: DataFrame) -> DataFrame:
    """``(response_id, reason)`` for records without body, metadata or endpoint."""
    reasons = F.filter(
        F.array(
            F.when(F.col("endpoint").isNull(), F.lit("missing endpoint")),
            F.when(F.col("response_body_bytes").isNull(), F.lit("missing response_body_bytes")),
            F.when(F.col("request_metadata_json").isNull(), F.lit("missing request_metadata_json")),
        ),
        lambda r: r.isNotNull(),
    )
    return raw.select("run_id", "response_id", F.explode(reasons).alias("reason"))


# --- usable responses -------------------------------------------------------


def single_result(body: Column) -> Column:
    """First result of the first task, if it is an object."""
    first = "$.tasks[0].result[0]"
    return F.when(V.object_at(body, first), V.at(body, first))


def successful_empty(body: Column) -> Column:
    """A successful task that found nothing."""
    task = V.at(body, "$.tasks[0]")
    ok = lambda node: F.coalesce(V.strict_integer(node, "$.status_code").isin(200, 20000), F.lit(True))
    result = V.at(task, "$.result")
    none = V.is_missing(result) & (
        V.is_missing(V.at(task, "$.result_count")) | F.coalesce(V.number(task, "$.result_count") == 0, F.lit(False))
    )
    empty = none | (V.is_array(result) & V.at(result, "$[0]").isNull())
    # A first result settles it; the other parts are not looked at then.
    return F.when(V.object_at(body, "$.tasks[0].result[0]"), F.lit(False)).otherwise(V.is_object(task) & ok(body) & ok(task) & empty)


def legacy_backlinks(result: Column) -> Column:
    return (
        result.isNotNull()
        & ~V.has_key(result, "$.backlinks")
        & (V.has_key(result, "$.total_count") | V.has_key(result, "$.items_count"))
    )


def backlinks_usable(body: Column, variant: Column) -> Column:
    result = single_result(body)
    links = V.is_number(V.at(result, "$.backlinks"))
    domains = V.is_number(V.at(result, "$.referring_domains"))
    aggregates = F.when(variant == "dofollow", links).when(variant == "summary", links & domains).otherwise(F.lit(False))
    detail = F.size(violations(body, "backlinks_detail")) == 0
    return successful_empty(body) | F.when(variant == "detail", detail).otherwise(
        result.isNotNull() & ~legacy_backlinks(result) & aggregates
    )


def onpage_item(body: Column) -> Column:
    """First item with a URL and a numeric score."""
    fits = F.filter(
        V.task_items(body),
        lambda i: F.coalesce(V.text(i, "$.url") != "", F.lit(False)) & V.is_number(V.at(i, "$.onpage_score")),
    )
    return F.get(fits, F.lit(0))


def onpage_usable(body: Column) -> Column:
    return (F.size(violations(body, "onpage_instant_pages")) == 0) & onpage_item(body).isNotNull()


def serp_usable(body: Column, depth: int | None = None) -> Column:
    """All tasks succeeded and the organic rows reach the depth (at least one without)."""
    tasks = V.shaped_tasks(body, {"task": ["status_code"]})
    fine = (F.size(tasks) > 0) & F.forall(
        tasks,
        lambda t: t.isNotNull() & F.coalesce(V.strict_integer(t["status_code"], "$") == 20000, F.lit(True)),
    )
    return F.coalesce(fine & (F.size(usable_organic(body)) >= (depth or 1)), F.lit(False))


def text_analysis_usable(body: Column) -> Column:
    return V.is_object(body) & V.is_missing(V.at(body, "$.error"))
