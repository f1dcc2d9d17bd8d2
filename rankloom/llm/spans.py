"""Spans of regular expressions in code points, with built-in functions only.

Spark returns the matches of a pattern and the pieces between them; the running
sum of both lengths is where a match starts.  No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:string,value:string>"


def found(text: Column, kind: str, pattern: str | Column, needs: Column | None = None) -> Column:
    """Array of (start, end, kind, value) of the leftmost non-overlapping matches.

    ``pattern`` is a Java pattern (or a column of them) that never matches the empty string;
    ``needs`` is a cheap condition that every matching text fulfils.
    """
    pattern = F.lit(pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    # One step per match: where it starts, and where the next gap starts.
    located = F.aggregate(
        F.arrays_zip(matches.alias("value"), F.slice(gaps, 1, F.size(matches)).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gap"]) + F.length(m["value"])).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(m["gap"])).alias("start"),
                        (acc["at"] + F.length(m["gap"]) + F.length(m["value"])).alias("end"),
                        F.lit(kind).alias("kind"),
                        m["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    present = F.rlike(text, pattern) if needs is None else needs & F.rlike(text, pattern)
    return F.when(present, located).otherwise(F.array().cast(f"array<{SPAN}>"))


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans by start, then kind as listed, then end."""
    place = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
