"""Page scores: rule-based, from stored embeddings, or from a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankloom import schemas as S
from rankloom.functions import variant as V
from rankloom.functions.text import (
    stripped,
    canonical_url,
    document_prompt,
    fold_case,
    overlap_score,
    query_prompt,
    semantic_prompt,
    stable_id,
)
from rankloom.functions.vectors import cosine, rule_semantic_vector, rule_vector
from rankloom.operators.quality import ContractError
from rankloom.operators.groups import first_per_key

# Fixed value: roles of a stored embedding.
ROLES = ("retrieval_query", "semantic_query", "retrieval_document", "semantic_page")


def rule_scores(frame: DataFrame, keyword: str = "target_keyword", text: str = "text") -> DataFrame:
    """Raw and normalised score of the three scorers for each (keyword, page) row."""
    k, t = F.col(keyword), F.coalesce(F.col(text), F.lit(""))
    values = {
        "bge": overlap_score(k, t),
        "gemini_doc_retrieval": cosine(rule_vector(k), rule_vector(t)),
        "gemini_semantic_similarity": cosine(rule_semantic_vector(k), rule_semantic_vector(t)),
    }
    return frame.select(
        "*", *[v.alias(f"{n}_{kind}_score") for n, v in values.items() for kind in ("raw", "normalized")]
    )


def page_rollup(
    passages: DataFrame,
    similarity: Column,
    page: str = "url",
    passage: str = "passage_id",
    position: str = "position",
) -> DataFrame:
    """Count, best and mean similarity per page, and the best passage (first on a tie)."""
    scored = passages.withColumn("__s", similarity)
    return scored.groupBy(page).agg(
        F.count(F.lit(1)).alias("passage_count"),
        F.round(F.max("__s"), 6).alias("max_similarity"),
        F.round(F.avg("__s"), 6).alias("mean_similarity"),
        F.max_by(passage, F.struct(F.col("__s"), -F.col(position))).alias("best_passage_id"),
    )


def embedding_identity(
    role: Column, keyword: Column, url: Column, input_sha256: Column, model: Column, dimensions: Column
) -> list[Column]:
    return [
        role.alias("role"),
        stripped(fold_case(F.coalesce(keyword, F.lit("")))).alias("keyword_key"),
        F.when(F.coalesce(url, F.lit("")) != "", canonical_url(url)).otherwise(F.lit("")).alias("url_key"),
        input_sha256.alias("input_sha256"),
        model.alias("model"),
        dimensions.cast("bigint").alias("output_dimensionality"),
    ]


IDENTITY = ("role", "keyword_key", "url_key", "input_sha256", "model", "output_dimensionality")


def stored_embeddings(raw: DataFrame) -> DataFrame:
    """Identity and vector of every stored embedding; the latest record wins."""
    rows = raw.where(F.col("endpoint") == "gemini_embeddings").select(
        "target_keyword",
        "timestamp",
        "response_id",
        F.try_parse_json("request_metadata_json").alias("meta"),
        V.parse_body("response_body_bytes").alias("body"),
    )
    m, first = F.col("meta"), F.get(V.elements(F.col("body"), "$.embeddings"), F.lit(0))
    values = F.transform(V.elements(first, "$.values"), lambda x: V.number(x, "$"))
    typed = rows.select(
        *embedding_identity(
            V.text(m, "$.role"),
            F.col("target_keyword"),
            V.text(m, "$.url"),
            V.text(m, "$.input_sha256"),
            V.text(m, "$.model"),
            V.strict_integer(m, "$.output_dimensionality"),
        ),
        F.when(V.is_array(V.at(first, "$.values")), values).alias("vector"),
        "timestamp",
        "response_id",
    ).where("vector is not null and role is not null and input_sha256 is not null and model is not null")
    latest = first_per_key(typed, list(IDENTITY), [F.coalesce("timestamp", F.lit("")).desc(), F.col("response_id").desc()])
    return latest.drop("timestamp", "response_id")


def stored_scores(frame: DataFrame, stored: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Scores of (keyword, page) rows whose four embeddings are stored.

    ``frame`` has target_keyword, url, title and text.  Query vectors depend on the
    keyword alone and page vectors on the page alone, so each is looked up on its
    distinct inputs and joined to the pairs; a missing vector leaves a null score.
    """

    def vectors(inputs: DataFrame, role: str, keyword: Column, url: Column, content: Column, out: str, key: str):
        wanted = inputs.select(
            key,
            *embedding_identity(F.lit(role), keyword, url, F.sha2(content, 256), F.lit(model), F.lit(dimensions)),
        )
        return wanted.join(stored, list(IDENTITY), "inner").select(F.col(key), F.col("vector").alias(out))

    none = F.lit(None).cast("string")
    keywords = frame.select("target_keyword").distinct()
    page_id = stable_id("url", "title", "text")
    pairs = frame.withColumn("__page", page_id)
    pages = pairs.select("__page", "url", "title", "text").dropDuplicates(["__page"])
    k = F.col("target_keyword")
    q1 = vectors(keywords, "retrieval_query", k, none, query_prompt(k), "__q1", "target_keyword")
    q2 = vectors(keywords, "semantic_query", k, none, semantic_prompt(k), "__q2", "target_keyword")
    d1 = vectors(pages, "retrieval_document", none, F.col("url"), document_prompt("text", F.col("title")), "__d1", "__page")
    d2 = vectors(pages, "semantic_page", none, F.col("url"), semantic_prompt("text"), "__d2", "__page")
    joined = (
        pairs.join(q1, "target_keyword", "left")
        .join(q2, "target_keyword", "left")
        .join(d1, "__page", "left")
        .join(d2, "__page", "left")
    )
    return joined.select(
        *frame.columns,
        overlap_score("target_keyword", "text").alias("bge_raw_score"),
        cosine(F.col("__q1"), F.col("__d1")).alias("gemini_doc_retrieval_raw_score"),
        cosine(F.col("__q2"), F.col("__d2")).alias("gemini_semantic_similarity_raw_score"),
    )


def score_with_model(
    frame: DataFrame,
    load_model: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]],
    keyword: str = "target_keyword",
    text: str = "text",
    out: str = "score",
) -> DataFrame:
    """Score rows with a caller's model, loaded once per task and fed Arrow batches.

    Only the two text columns cross into Python with a row; the rest comes along
    untouched in the same batch.
    """
    schema = StructType([*frame.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            yield batch.assign(**{out: pd.Series(model(batch[keyword], batch[text]), index=batch.index, dtype="float64")})

    return frame.mapInPandas(run, schema)


def similarity_table(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Curated score rows of all pages; a page without a score keeps nulls.

    Check the result with a non-null contract on the scores: a missing score is an
    error of the run, and the contract names the columns.
    """
    keyed = scores.select("target_keyword", "url", *[f"{s}_{k}_score" for s in S.SCORERS for k in ("raw", "normalized")])
    rows = pages.join(keyed, ["target_keyword", "url"], "left")
    return rows.select(
        *[
            (F.lit(S.CURATED_VERSION) if f.name == "schema_version" else F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name != "score_row_id"
            else stable_id("run_id", "target_keyword", "url").alias("score_row_id")
            for f in S.CURATED["similarity_scores"].fields
        ]
    )


def require_scores(rows: DataFrame, scorers: Sequence[str] = S.SCORERS, named: int = 5) -> DataFrame:
    """``rows`` if every page has every scorer's scores; otherwise the job stops and names some of the pages."""
    lacking = [f"{s}_{k}_score" for s in scorers for k in ("raw", "normalized")]
    gaps = rows.select("target_keyword", "url", F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in lacking])).alias("gaps")).where(F.size("gaps") > 0)
    found = gaps.orderBy("target_keyword", "url").limit(named).collect()
    if found:
        raise ContractError("; ".join(f"{r['target_keyword']} {r['url']}: no {', '.join(r['gaps'])}" for r in found))
    return rows
