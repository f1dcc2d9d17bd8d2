"""Strictly typed getters on Variant columns.

``try_variant_get`` converts between types (``true`` -> 1, ``"5"`` -> 5).  A JSON
boolean must not count as a number nor a string as either, so every getter looks
at the stored type first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import stripped

NUMBER_TYPES = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
# A whole number too large for a bigint is stored as a decimal without fraction.
INTEGER_TYPES = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,\s?0\))$"


def parse_body(body: Column | str, binary: bool = True) -> Column:
    b = F.col(body) if isinstance(body, str) else body
    return F.try_parse_json(F.decode(b, "UTF-8") if binary else b)


def at(v: Column, path: str) -> Column:
    """The value under a path, still as a Variant; null if it is absent."""
    return v if path == "$" else F.try_variant_get(v, path, "variant")


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """Container tests are casts that copy nothing: describing the type would walk the whole subtree."""
    return object_at(v, "$")


def object_at(v: Column, path: str) -> Column:
    """The value under a path is an object; it isn't copied for that."""
    return F.try_variant_get(v, path, "struct<`-`:boolean>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<struct<`-`:boolean>>").isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(type_of(v) == "STRING", F.lit(False))


def is_boolean(v: Column) -> Column:
    return F.coalesce(type_of(v) == "BOOLEAN", F.lit(False))


def is_number(v: Column) -> Column:
    return F.coalesce(F.rlike(type_of(v), F.lit(NUMBER_TYPES)), F.lit(False))


def is_integer(v: Column) -> Column:
    # JSON keeps whole numbers as bigint; the pattern is for what does not fit and for values built otherwise.
    return F.coalesce((type_of(v) == "BIGINT") | F.rlike(type_of(v), F.lit(INTEGER_TYPES)), F.lit(False))


def is_missing(v: Column) -> Column:
    """Absent or JSON null."""
    return v.isNull() | F.is_variant_null(v)


def text(v: Column, path: str) -> Column:
    x = at(v, path)
    return F.when(is_string(x), F.try_variant_get(v, path, "string"))


def boolean(v: Column, path: str) -> Column:
    x = at(v, path)
    return F.when(is_boolean(x), F.try_variant_get(v, path, "boolean"))


def number(v: Column, path: str) -> Column:
    x = at(v, path)
    return F.when(is_number(x), F.try_variant_get(v, path, "double"))


def integer(v: Column, path: str) -> Column:
    """A number cut towards zero; booleans and strings give null."""
    x = at(v, path)
    return F.when(is_number(x), F.try_variant_get(v, path, "bigint"))


def strict_integer(v: Column, path: str) -> Column:
    """A whole JSON number only."""
    x = at(v, path)
    return F.when(is_integer(x), F.try_variant_get(v, path, "bigint"))


def elements(v: Column, path: str = "$") -> Column:
    """Array elements as Variants; an empty list unless the value is an array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), no_variants())


def no_variants() -> Column:
    return F.expr("cast(array() as array<variant>)")


def objects(v: Column, path: str = "$") -> Column:
    """Only the object elements of an array."""
    return F.filter(elements(v, path), is_object)


def array_length(v: Column, path: str) -> Column:
    """Length of an array, null for anything else."""
    a = F.try_variant_get(v, path, "array<variant>")
    return F.when(a.isNotNull(), F.size(a).cast("bigint"))


def keys(v: Column, path: str) -> Column:
    """Key names of an object, null for anything else."""
    return F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))


def has_key(v: Column, path: str) -> Column:
    """The key exists, even with a JSON null."""
    return at(v, path).isNotNull()


def has_key_prefix(v: Column, path: str, prefix: str) -> Column:
    return F.exists(keys(v, path), lambda k: k.startswith(prefix))


def sorted_json(v: Column, path: str) -> Column:
    """Compact JSON text with sorted keys, for objects only."""
    x = at(v, path)
    return F.when(is_object(x), F.to_json(x))


def task_results(body: Column) -> Column:
    """All results of all tasks, in document order.

    Elements that are no objects stay in: every getter gives null on them.
    """
    return F.flatten(F.transform(elements(body, "$.tasks"), lambda task: elements(task, "$.result")))


def task_items(body: Column) -> Column:
    """All items of all results, in document order."""
    return F.flatten(F.transform(task_results(body), lambda result: elements(result, "$.items")))


def shaped_tasks(body: Column, fields: dict[str, Iterable[str]]) -> Column:
    """Tasks, results and items as nested structs whose leaves are the named Variant fields of each level.

    One walk of the body; getters on the elements of ``task_items`` copy every level and look each field up again.
    ``fields`` names the levels that are wanted ("task", "result", "item").  A level that is no array is null, and so is
    an element that is no object.
    """
    return F.try_variant_get(body, "$.tasks", f"array<{_level('task', fields)}>")


_BELOW = {"task": ("result", "result"), "result": ("items", "item")}


def _level(level: str, fields: dict[str, Iterable[str]]) -> str:
    parts = [f"`{name}`:variant" for name in fields[level]]
    if level in _BELOW and _BELOW[level][1] in fields:
        name, below = _BELOW[level]
        parts.append(f"`{name}`:array<{_level(below, fields)}>")
    return f"struct<{','.join(parts)}>"


def item_fields(body: Column, names: Iterable[str]) -> Column:
    """The named fields of all items of all results, as structs of Variants, in document order; null for no objects."""
    fields = {"task": (), "result": (), "item": tuple(names)}
    none = F.expr(f"cast(array() as array<{_level('item', fields)}>)")
    inside = lambda result: F.coalesce(result["items"], none)
    results = lambda task: F.coalesce(F.flatten(F.transform(task["result"], inside)), none)
    return F.coalesce(F.flatten(F.transform(shaped_tasks(body, fields), results)), none)


def first_text(candidates: Iterable[Column]) -> Column:
    """First candidate that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in candidates])
