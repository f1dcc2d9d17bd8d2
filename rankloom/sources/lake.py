"""Reading the raw lake, the curated tables and side inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom import schemas as S
from rankloom.functions import variant as V
from rankloom.functions.text import blocking_host, canonical_url, fold_case, stripped
from rankloom.operators.curate import classified_page_text, open_bodies, parsed_pages, response_url
from rankloom.operators.drift import onpage_item, onpage_usable, serp_usable, text_analysis_usable
from rankloom.operators.groups import first_per_key
from rankloom.operators.signals import latest_usable_backlinks
from rankloom.sources import versions


class MissingTable(FileNotFoundError):
    """A stored run lacks a table."""


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """The raw lake, partitioned by endpoint; columns older files lack are null."""
    return spark.read.schema(S.RAW).parquet(root)


def scan_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A named table of a run; the fixed schema fills missing columns with nulls.

    A table with commits is read at its current version, a plain folder as it is.
    """
    schema = schema or S.CURATED.get(name)
    path = versions.current(spark, f"{root}/{name}") or f"{root}/{name}"
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        raise MissingTable(f"the run at {root} has no table {name}") from error


def scan_optional(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """A table or, if it was never written, an empty frame of its schema."""
    try:
        return scan_table(spark, root, name, schema)
    except MissingTable:
        return spark.createDataFrame([], schema)


def endpoint_rows(raw: DataFrame, endpoint: str) -> DataFrame:
    return raw.where(F.col("endpoint") == endpoint)


BRANCHES = ("keyword_expansion", "serp", "page_text", "backlinks", "onpage_instant_pages", "entities")
BRANCH_COLUMNS = (
    "run_id endpoint response_id target_keyword timestamp request_metadata_json response_body_bytes"
).split()


def branches(raw: DataFrame) -> dict[str, DataFrame]:
    """One narrow branch per kind of response; each prunes to its own partitions.

    Nothing is cached: a branch reads only its endpoint folders, so the branches
    together read the lake once.
    """
    out = {}
    for name in BRANCHES:
        kept = F.col("endpoint").startswith("backlinks") if name == "backlinks" else F.col("endpoint") == name
        out[name] = raw.where(kept).select(*BRANCH_COLUMNS)
    return out


def stored_body(raw: DataFrame, response_id: str) -> DataFrame:
    """Point lookup; the id filter reaches the Parquet reader."""
    return raw.where(F.col("response_id") == response_id).select(
        "response_id", F.decode("response_body_bytes", "UTF-8").alias("body")
    )


def blocklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct hosts of a text source: first token per line, ``#`` starts a comment line."""
    line = stripped(F.col(column))
    return (
        lines.where((line != "") & ~line.startswith("#"))
        .select(blocking_host(F.regexp_extract(line, r"^(\S+)", 1)).alias("domain"))
        .where("domain is not null")
        .distinct()
    )


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return blocklist(spark.read.text(path))


def manifest_scores(manifest: DataFrame) -> DataFrame:
    """Flatten ``page_similarity`` entries of run manifests; the last entry per URL wins.

    The manifest is read as one JSON text per row (``body`` column, ``run_id``).
    """
    entry = F.posexplode(V.objects(F.try_parse_json("body"), "$.page_similarity")).alias("position", "entry")
    rows = manifest.select("run_id", entry)
    e = F.col("entry")
    scores = [
        V.number(e, f"$.page_similarity.{s}.{k}_score").alias(f"{s}_{k}_score") for s in S.SCORERS for k in ("raw", "normalized")
    ]
    flat = rows.select(
        "run_id", V.text(e, "$.target_keyword").alias("target_keyword"), V.text(e, "$.url").alias("url"), "position", *scores
    )
    return first_per_key(flat, ["run_id", "target_keyword", "url"], [F.col("position").desc()]).drop("position")


def keyword_statuses(raw: DataFrame, depth: int = 20) -> DataFrame:
    """Per keyword: does any stored ranking response reach the depth?"""
    opened = open_bodies(raw, "serp")
    return (
        opened.where("target_keyword is not null and response_body_bytes is not null")
        .groupBy(fold_case("target_keyword").alias("keyword_key"))
        .agg(F.bool_or(serp_usable(F.col("body"), depth)).alias("usable"))
    )


def pages_to_analyse(raw: DataFrame, curated_pages: DataFrame) -> DataFrame:
    """Pages of the raw lake; curated pages only for keywords the lake has none for."""
    columns = ["target_keyword", "url", "title", "text"]
    fresh = parsed_pages(raw).where("text != ''").select(*columns, F.lit("raw").alias("source"))
    have = fresh.select(stripped(fold_case("target_keyword")).alias("__k")).distinct()
    older = (
        curated_pages.where(stripped("text") != "")
        .select(*columns, F.lit("curated").alias("source"))
        .withColumn("__k", stripped(fold_case("target_keyword")))
        .join(have, "__k", "left_anti")
        .drop("__k")
    )
    both = fresh.unionByName(older)
    # Equal (keyword, URL) rows differ only in text; the smallest one makes the choice stable.
    keyed = both.withColumns({"__k": stripped(fold_case("target_keyword")), "__u": stripped("url")})
    return first_per_key(keyed, ["__k", "__u"], [F.col("title").asc(), F.col("text").asc()]).drop("__k", "__u")


def _latest(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    keyed = rows.where("url is not null").withColumn("canonical_url", canonical_url("url"))
    return first_per_key(
        keyed, ["target_keyword", "canonical_url", *extra], [F.coalesce("timestamp", F.lit("")).desc(), F.col("response_id").desc()]
    )


def reusable_responses(raw: DataFrame) -> dict[str, DataFrame]:
    """Latest usable stored response per (keyword, canonical URL), by kind."""
    body = F.col("body")
    columns = ("target_keyword", "response_id", "timestamp", "url")
    onpage = open_bodies(raw, "onpage_instant_pages").where(onpage_usable(body))
    item_url = V.text(onpage_item(body), "$.url")
    text = open_bodies(raw, "entities").where(text_analysis_usable(body))
    return {
        "onpage": _latest(onpage.withColumn("url", response_url(body, item_url)).select(*columns)),
        "text_analysis": _latest(text.withColumn("url", response_url(body)).select(*columns)),
        "backlinks": latest_usable_backlinks(raw),
        "page_text": best_page_text(raw).where("usable"),
    }


def best_page_text(raw: DataFrame) -> DataFrame:
    """Best stored page text per (keyword, canonical URL): usable first, then latest."""
    rows = classified_page_text(raw).where("url is not null").withColumn("usable", F.col("response_class") == "usable")
    keyed = rows.withColumn("canonical_url", canonical_url("url"))
    return (
        keyed.groupBy("target_keyword", "canonical_url")
        .agg(
            F.max_by(
                F.struct("response_id", "url", "usable", "response_class"),
                F.struct("usable", F.coalesce("timestamp", F.lit("")).alias("t"), "response_id"),
            ).alias("b")
        )
        .select("target_keyword", "canonical_url", "b.*")
    )
