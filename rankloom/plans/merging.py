"""Queries for upserts, run combination and missing work."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import merge as G
from rankloom.operators.filters import owned_rows
from rankloom.plans.standins import table
from rankloom.sources.sinks import changed_partitions

_OLD = "event_id % 3 <> 0"


def _events(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id", "event_type", "event_id", "value")
    return rows.where(_OLD), rows.where(f"NOT ({_OLD})")


def upsert_new(spark, d):
    old, new = _events(spark, d)
    return G.upsert(old, new, ["user_id", "event_type"], ["event_id"])


UPSERT_NEW = """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 = 0 DESC, event_id DESC) = 1"""


def upsert_existing(spark, d):
    old, new = _events(spark, d)
    return G.upsert(old, new, ["user_id", "event_type"], ["event_id"], new_wins=False)


UPSERT_EXISTING = """SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 = 0, event_id) = 1"""


def replayed(spark, d):
    """Stored orders replayed with a changed body for status F and extra orders."""
    stored = table(spark, d, "orders").selectExpr("o_orderkey AS k", "'serp' AS endpoint", "o_orderstatus AS body", "'old' AS origin")
    rebuilt = table(spark, d, "orders").selectExpr(
        "if(o_orderkey % 10 = 0, -o_orderkey - 1, o_orderkey) AS k", "if(o_orderkey % 7 = 0, 'keyword_expansion', 'serp') AS endpoint",
        "if(o_orderstatus = 'F', 'f', o_orderstatus) AS body", "'new' AS origin",
    )
    return G.merge_replayed(stored, rebuilt, ["k"], "body")


REPLAYED = """SELECT o_orderkey AS k, 'serp' AS endpoint,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AND o_orderkey % 10 <> 0 THEN 'f' ELSE o_orderstatus END AS body,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AND o_orderkey % 10 <> 0 THEN 'new' ELSE 'old' END AS origin FROM orders
UNION ALL SELECT -o_orderkey - 1, 'serp', CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE o_orderstatus END, 'new' FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0"""


def merged_scores(spark, d):
    base = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_tax").alias("bge"), F.max("l_discount").alias("doc"))
    later = table(spark, d, "part").selectExpr("p_partkey + 5 AS l_partkey", "if(p_size % 2 = 0, p_size / 10, NULL) AS doc", "CAST(p_size AS double) AS sem")
    return G.merge_scores(base, later, ["l_partkey"], ["bge", "doc", "sem"])


MERGED_SCORES = """WITH b AS (SELECT l_partkey, max(l_tax) AS bge, max(l_discount) AS doc FROM lineitem GROUP BY 1),
l AS (SELECT p_partkey + 5 AS l_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 10 END AS doc, p_size::DOUBLE AS sem FROM part)
SELECT l_partkey, b.bge, coalesce(l.doc, b.doc) AS doc, l.sem FROM b FULL JOIN l USING (l_partkey)"""


def enriched_scores(spark, d):
    scores = table(spark, d, "documents").selectExpr("lang AS target_keyword", "concat('u', doc_id) AS url", "n_chars")
    metrics = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").selectExpr(
        "lang AS target_keyword", "concat('u', doc_id) AS url", "n_chars / 7 AS textrazor_entity_confidence_score", "quality / 3 AS textrazor_entity_relevance_score"
    )
    return G.enrich_scores(scores, metrics)


ENRICHED_SCORES = """SELECT lang AS target_keyword, 'u' || d.doc_id AS url, n_chars,
  CASE WHEN l.doc_id IS NOT NULL THEN round(n_chars / 7, 6) END AS textrazor_entity_confidence_score, round(quality / 3, 6) AS textrazor_entity_relevance_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def invalidated(spark, d):
    """Orders of refreshed customers are replaced by recomputed rows."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    refreshed = table(spark, d, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS o_custkey")
    again = orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("R"))
    return G.invalidate(orders, refreshed, ["o_custkey"], again)


INVALIDATED = """SELECT o_custkey, o_orderkey, CASE WHEN c_acctbal < 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_acctbal IS NULL OR c_acctbal >= 0 OR o_orderkey % 2 = 0"""


def _runs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("target_keyword_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return G.union_runs([(flag, rows.where(F.col("l_returnflag") == flag).drop("l_returnflag")) for flag in ("N", "R", "A")])


_RUNS = """u AS (SELECT l_partkey AS target_keyword_id, l_orderkey, l_linenumber, l_suppkey, l_returnflag AS source_run,
  CAST(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS BIGINT) AS run_order FROM lineitem)"""


def combined_runs(spark, d):
    return G.combine_runs(_runs(spark, d)).select("target_keyword_id", "l_orderkey", "l_linenumber", "l_suppkey", "source_run")


COMBINED_RUNS = f"""WITH {_RUNS} SELECT target_keyword_id, l_orderkey, l_linenumber, l_suppkey, source_run FROM u
QUALIFY run_order = max(run_order) OVER (PARTITION BY target_keyword_id)"""


def keyword_owners(spark, d):
    return G.keyword_owners(_runs(spark, d))


KEYWORD_OWNERS = f"""WITH {_RUNS} SELECT target_keyword_id, max(run_order) AS run_order, arg_max(source_run, run_order) AS owner FROM u GROUP BY 1"""


def keyword_overlaps(spark, d):
    return G.keyword_overlaps(_runs(spark, d)).select("target_keyword_id", "selected_run", F.array_join("dropped_runs", ",").alias("dropped_runs"))


KEYWORD_OVERLAPS = f"""WITH {_RUNS}, d AS (SELECT DISTINCT target_keyword_id, source_run, run_order FROM u),
g AS (SELECT target_keyword_id, list(source_run ORDER BY run_order) AS l FROM d GROUP BY 1)
SELECT target_keyword_id, l[-1] AS selected_run, array_to_string(l[1:len(l) - 1], ',') AS dropped_runs FROM g WHERE len(l) > 1"""


def owned(spark, d):
    owners = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return owned_rows(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), owners, ["l_suppkey"])


OWNED = "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"


def config_mismatches(spark, d):
    configs = table(spark, d, "nation").selectExpr("n_name AS source_run", "n_regionkey AS depth", "'desktop' AS device", "if(n_nationkey = 3, NULL, 'en') AS language")
    out = G.config_mismatches(configs, ["depth", "device", "language"])
    values = F.array_join(F.transform("run_values", lambda r: F.concat(r["run"], F.lit("="), r["value"])), ",")
    return out.withColumn("run_values", values)


CONFIG_MISMATCHES = """WITH v AS (
  SELECT 'depth' AS field, n_name AS run, '{"value":' || n_regionkey || '}' AS value FROM nation
  UNION ALL SELECT 'device', n_name, '{"value":"desktop"}' FROM nation
  UNION ALL SELECT 'language', n_name, CASE WHEN n_nationkey = 3 THEN '{"value":null}' ELSE '{"value":"en"}' END FROM nation)
SELECT field, count(DISTINCT value) AS distinct_values, count(*) AS run_count, string_agg(run || '=' || value, ',' ORDER BY run, value) AS run_values
FROM v GROUP BY field HAVING count(DISTINCT value) > 1"""


def missing_urls(spark, d):
    ranked = table(spark, d, "pages").select("page_id", "url")
    stored = table(spark, d, "pages").where("page_id % 4 = 1").selectExpr("concat(url, '#again') AS url")
    return G.missing_urls(ranked, stored, [F.col("page_id").asc()]).select("page_id", "url")


MISSING_URLS = """WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])utm_source=[^&]*', ''), '[?&]$', '') AS canon FROM pages)
SELECT page_id, url FROM c WHERE canon NOT IN (SELECT canon FROM c WHERE page_id % 4 = 1)
QUALIFY row_number() OVER (PARTITION BY canon ORDER BY page_id) = 1"""


def score_completeness(spark, d):
    ranked = table(spark, d, "lineitem").select(F.col("l_suppkey"), F.col("l_partkey")).distinct()
    scores = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_partkey", "nullif(l_tax, 0) AS bge", "nullif(l_linenumber, 3) AS doc").where("l_partkey % 9 <> 0")
    return G.score_completeness(ranked, scores, ["bge", "doc"], ["l_suppkey", "l_partkey"])


SCORE_COMPLETENESS = """WITH s AS (SELECT l_suppkey, l_partkey, bool_or(l_tax <> 0 AND l_linenumber <> 3) AND l_partkey % 9 <> 0 AS f FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS url_count, count(*) FILTER (f) AS scored_count, bool_and(f) AS is_complete FROM s GROUP BY 1"""


def missing_variants(spark, d):
    urls = table(spark, d, "orders").select("o_orderkey")
    usable = table(spark, d, "orders").selectExpr("o_orderkey", "if(o_orderstatus = 'F', 'dofollow', 'summary') AS variant")
    return G.missing_variants(urls, usable, ["summary", "dofollow"], ["o_orderkey"])


MISSING_VARIANTS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'summary' ELSE 'dofollow' END AS variant FROM orders"


def changed_scope(spark, d):
    keywords = table(spark, d, "customer").selectExpr("upper(c_name) AS target_keyword", "c_mktsegment AS scope")
    statuses = table(spark, d, "customer").where("c_custkey % 5 <> 0").selectExpr(
        "c_name AS keyword_key", "c_custkey % 3 <> 0 AS usable", "if(c_custkey % 7 = 0, 'OTHER', c_mktsegment) AS scope"
    )
    return G.changed_scope(keywords, statuses)


CHANGED_SCOPE = """SELECT upper(c_name) AS target_keyword, c_mktsegment AS scope,
  CASE WHEN c_custkey % 5 = 0 THEN 'not stored' WHEN c_custkey % 7 = 0 THEN 'scope changed' ELSE 'not usable' END AS reason
FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 3 = 0"""


def partitions_changed(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderpriority").alias("endpoint"), "o_orderkey", "o_orderstatus")
    new = old.where("NOT (endpoint = '2-HIGH' AND o_orderstatus = 'P')")
    return changed_partitions(new, old)


PARTITIONS_CHANGED = "SELECT DISTINCT o_orderpriority AS endpoint FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'"


QUERIES = {
    "upsert_new": (upsert_new, UPSERT_NEW),
    "upsert_existing": (upsert_existing, UPSERT_EXISTING),
    "replayed": (replayed, REPLAYED),
    "merged_scores": (merged_scores, MERGED_SCORES),
    "enriched_scores": (enriched_scores, ENRICHED_SCORES),
    "invalidated": (invalidated, INVALIDATED),
    "combined_runs": (combined_runs, COMBINED_RUNS),
    "keyword_owners": (keyword_owners, KEYWORD_OWNERS),
    "keyword_overlaps": (keyword_overlaps, KEYWORD_OVERLAPS),
    "owned_rows": (owned, OWNED),
    "config_mismatches": (config_mismatches, CONFIG_MISMATCHES),
    "missing_urls": (missing_urls, MISSING_URLS),
    "score_completeness": (score_completeness, SCORE_COMPLETENESS),
    "missing_variants": (missing_variants, MISSING_VARIANTS),
    "changed_scope": (changed_scope, CHANGED_SCOPE),
    "partitions_changed": (partitions_changed, PARTITIONS_CHANGED),
}
