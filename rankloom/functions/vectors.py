"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import fold_case


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, digits: int | None = 6) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    norms = norm(a) * norm(b)
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))
    return value if digits is None else F.round(value, digits)


def logistic(x: Column, digits: int | None = 6) -> Column:
    value = 1.0 / (1.0 + F.exp(-x))
    return value if digits is None else F.round(value, digits)


def _marked(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(fold_case(text), F.lit(word))
    return out


# The marker words and vectors of the rule-based embeddings.
CRAWL_MARKERS = ("technical seo", "crawling")
INDEX_MARKERS = ("index", "canonical")


def rule_vector(text: Column) -> Column:
    """Two-dimensional rule-based vector."""
    return (
        F.when(_marked(text, CRAWL_MARKERS), F.array(F.lit(1.0), F.lit(0.0)))
        .when(_marked(text, INDEX_MARKERS), F.array(F.lit(1.0), F.lit(1.0)))
        .otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    )


def rule_semantic_vector(text: Column) -> Column:
    """Three-dimensional rule-based vector."""
    return (
        F.when(_marked(text, CRAWL_MARKERS), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        .when(_marked(text, INDEX_MARKERS), F.array(F.lit(0.6), F.lit(0.8), F.lit(0.0)))
        .otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    )
