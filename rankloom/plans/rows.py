"""Queries for filters, projections, text functions and table contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankloom.functions import suffixes
from rankloom.functions import text as T
from rankloom.functions import vectors as VX
from rankloom.functions.numeric import all_present, any_present, log1p_signed, rank_outcome, row_mean
from rankloom.operators import filters, quality
from rankloom.operators.groups import top_per_key
from rankloom.operators.merge import missing_pages
from rankloom.plans import standins as st
from rankloom.plans.standins import table
from rankloom.session import ensure_checkpoint_dir
from rankloom.sources import sinks
from rankloom.sources.lake import blocklist
from rankloom.sources.sinks import dataset_catalog


def depth_expansion(spark, d):
    return (
        filters.expand_depths(st.panel(spark, d))
        .groupBy("rank_depth", "keyword_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.max("serp_rank").alias("worst_rank"), F.sum("l_quantity").alias("quantity"))
    )


DEPTH_EXPANSION = f"""WITH {st.PANEL}
SELECT rank_depth, keyword_id, count(*) AS row_count, max(serp_rank) AS worst_rank, sum(l_quantity) AS quantity
FROM panel JOIN (VALUES ('top_20', 20), ('top_10', 10), ('top_5', 5), ('top_3', 3)) t(rank_depth, max_rank)
  ON serp_rank BETWEEN 1 AND max_rank GROUP BY 1, 2"""


def rank_depth(spark, d):
    return filters.within_depth(st.panel(spark, d), 5).select("keyword_id", "url_id", "serp_rank", "l_extendedprice")


RANK_DEPTH = f"WITH {st.PANEL} SELECT keyword_id, url_id, serp_rank, l_extendedprice FROM panel WHERE serp_rank BETWEEN 1 AND 5"


def _block_lines(spark, d):
    return table(spark, d, "pages").selectExpr(
        "CASE WHEN url LIKE '%spam%' THEN concat('  HTTP://WWW.', split_part(split_part(url, '://', 2), '/', 1), '/x  # reason')"
        " WHEN url LIKE '%pills%' THEN 'cheap-pills.example.com   # listed' ELSE concat('# ', url) END AS value"
    )


def blocked_domains(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", "if(page_id % 50 = 7, NULL, url) AS url")
    return filters.drop_blocked_domains(pages, blocklist(_block_lines(spark, d)))


_HOST = "regexp_replace(split_part(split_part(lower(url), '://', 2), '/', 1), '^www\\.', '')"
BLOCKED_DOMAINS = f"""WITH entries AS (
  SELECT DISTINCT CASE WHEN url LIKE '%spam%' THEN {_HOST} ELSE 'cheap-pills.example.com' END AS e
  FROM pages WHERE url LIKE '%spam%' OR url LIKE '%pills%'),
p AS (SELECT page_id, CASE WHEN page_id % 50 = 7 THEN NULL ELSE url END AS url FROM pages)
SELECT page_id, url FROM p WHERE url IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM entries WHERE {_HOST} = e OR ends_with({_HOST}, '.' || e))"""


def unblocked_scores(spark, d):
    """Pages scored by length, kept where an unblocked ranked row of their keyword has their URL."""
    pages = table(spark, d, "pages")
    scored = pages.selectExpr("concat('k', page_id % 5) AS target_keyword", "url", "length(html) AS score")
    serp = pages.where("page_id % 3 <> 0").selectExpr("concat('k', page_id % 5) AS target_keyword", "url", "page_id AS serp_rank")
    return filters.unblocked_scores(scored, serp, blocklist(_block_lines(spark, d)))


UNBLOCKED_SCORES = f"""WITH entries AS (
  SELECT DISTINCT CASE WHEN url LIKE '%spam%' THEN {_HOST} ELSE 'cheap-pills.example.com' END AS e
  FROM pages WHERE url LIKE '%spam%' OR url LIKE '%pills%'),
open_urls AS (
  SELECT 'k' || page_id % 5 AS target_keyword, url FROM pages WHERE page_id % 3 <> 0 AND NOT EXISTS (
    SELECT 1 FROM entries WHERE {_HOST} = e OR ends_with({_HOST}, '.' || e)))
SELECT 'k' || page_id % 5 AS target_keyword, url, length(html) AS score FROM pages
WHERE ('k' || page_id % 5, url) IN (SELECT (target_keyword, url) FROM open_urls)"""


def blocklist_entries(spark, d):
    return blocklist(_block_lines(spark, d))


BLOCKLIST_ENTRIES = f"""SELECT DISTINCT CASE WHEN url LIKE '%spam%' THEN {_HOST} ELSE 'cheap-pills.example.com' END AS domain
FROM pages WHERE url LIKE '%spam%' OR url LIKE '%pills%'"""


def complete_controls(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nullif(l_tax, 0) AS site_scale", "nullif(l_discount, 0) AS authority_proxy"
    )
    return filters.complete_controls(rows).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("site_scale"), 4).alias("scale_sum"))


COMPLETE_CONTROLS = """SELECT l_suppkey, count(*) AS row_count, round(sum(l_tax), 4) AS scale_sum FROM lineitem
WHERE l_tax <> 0 AND l_discount <> 0 GROUP BY 1"""


def keyword_view(spark, d):
    rows = st.serp(spark, d).selectExpr(
        "target_keyword", "url", "serp_rank", "title", "l_tax AS textrazor_topic_score", "serp_item_id AS page_metrics_row_id"
    )
    return filters.keyword_view(rows, "supplier 7")


KEYWORD_VIEW = f"""WITH {st.SERP} SELECT serp_rank, target_keyword, title, url, l_tax AS textrazor_topic_score,
serp_item_id AS page_metrics_row_id FROM serp WHERE target_keyword = 'supplier 7'"""


def null_backfill(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    out = filters.with_null_columns(rows, {"p_size": "int", "score": "double", "tag": "string"})
    return out.groupBy("p_size").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("score").alias("scores"), F.max("tag").alias("tag")
    )


NULL_BACKFILL = "SELECT p_size, count(*) AS row_count, CAST(0 AS BIGINT) AS scores, CAST(NULL AS VARCHAR) AS tag FROM part GROUP BY 1"


def pages_missing_analysis(spark, d):
    docs = table(spark, d, "documents").selectExpr(
        "doc_id", "concat(' ', upper(lang)) AS target_keyword", "concat('https://d.example.com/', doc_id % 700) AS url",
        "if(doc_id % 17 = 0, '  ', text) AS text",
    )
    done = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").selectExpr(
        "lang AS target_keyword", "concat('https://d.example.com/', doc_id % 700, '#seen') AS url"
    )
    return missing_pages(docs, done, [F.col("doc_id").asc()]).select("doc_id", "target_keyword", "url", F.length("text").cast("bigint").alias("text_length"))


PAGES_MISSING_ANALYSIS = """WITH f AS (
  SELECT doc_id, ' ' || upper(lang) AS target_keyword, 'https://d.example.com/' || (doc_id % 700) AS url, text, lang,
    row_number() OVER (PARTITION BY lang, doc_id % 700 ORDER BY doc_id) AS rn
  FROM documents WHERE doc_id % 17 <> 0 AND trim(text) <> ''),
done AS (SELECT DISTINCT lang, doc_id % 700 AS u FROM labels JOIN documents USING (doc_id))
SELECT doc_id, target_keyword, url, CAST(length(text) AS BIGINT) AS text_length FROM f
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM done WHERE done.lang = f.lang AND 'https://d.example.com/' || u = f.url)"""


def url_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        T.hostname(u).alias("hostname"),
        T.blocking_host(u).alias("blocking_host"),
        T.canonical_url(u).alias("canonical_url"),
        T.stable_id(T.canonical_url(u)).alias("canonical_url_hash"),
        T.backlink_target(u).alias("target"),
        T.backlink_target(F.concat(F.lit("https://"), T.hostname(u), F.lit("/"))).alias("bare_target"),
        T.slug(u).alias("slug"),
    )


URL_FUNCTIONS = """WITH c AS (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host,
  regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])utm_source=[^&]*', ''), '[?&]$', '') AS canon FROM pages)
SELECT page_id, host AS hostname, regexp_replace(lower(host), '^www\\.', '') AS blocking_host, canon AS canonical_url,
  left(sha256(canon), 32) AS canonical_url_hash, url AS target, regexp_replace(host, '^www\\.', '') AS bare_target,
  regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM c"""


def paragraphs(spark, d):
    """Documents with a blank line after every line, cut into paragraphs again."""
    docs = table(spark, d, "documents").withColumn("spaced", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    blocks = docs.select("doc_id", F.posexplode(T.paragraph_blocks("spaced")).alias("position", "block"))
    return blocks.select(
        "doc_id", F.col("position").cast("bigint").alias("position"), T.word_count("block").alias("words"), F.md5("block").alias("digest")
    )


PARAGRAPHS = """WITH b AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: trim(regexp_replace(x, '[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g'))), lambda x: x <> '')) AS block,
    generate_subscripts(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: trim(regexp_replace(x, '[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g'))), lambda x: x <> ''), 1) - 1 AS position
  FROM documents)
SELECT doc_id, CAST(position AS BIGINT) AS position,
  CAST(len(regexp_extract_all(block, '[_\\p{L}\\p{N}][_''\\p{L}\\p{N}-]*')) AS BIGINT) AS words, md5(block) AS digest FROM b"""


def overlap(spark, d):
    """Each document scored against the two-word name of a part (a keyword per row)."""
    docs = table(spark, d, "documents")
    keyword = F.concat_ws(" ", F.get(F.split("text", " "), F.lit(0)), F.lit("the"), F.col("lang"))
    return docs.select("doc_id", T.overlap_score(keyword, F.col("text")).alias("score"))


OVERLAP = """WITH k AS (SELECT doc_id, lower(text) AS t, lower(split_part(text, ' ', 1) || ' the ' || lang) AS k FROM documents),
w AS (SELECT doc_id, t, k, list_distinct(regexp_extract_all(k, '[a-z0-9]+')) AS kw, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS tw FROM k)
SELECT doc_id, CASE WHEN contains(t, k) THEN 0.98 WHEN contains(t, 'index') OR contains(t, 'canonical') THEN 0.74
  WHEN len(list_intersect(kw, tw)) = 0 THEN 0.12
  ELSE round(least(0.12 + 0.78 * (CAST(len(list_intersect(kw, tw)) AS DOUBLE) / len(kw)), 0.97), 6) END AS score FROM w"""


def prompts(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id",
        T.query_prompt(t).alias("query_prompt"),
        T.document_prompt(t, F.concat(F.lit("Item "), F.col("item_id"))).alias("document_prompt"),
        T.semantic_prompt(t).alias("semantic_prompt"),
        T.fold_case(t).alias("folded"),
    )


PROMPTS = """SELECT item_id, 'task: search result | query: ' || text AS query_prompt,
  'title: Item ' || item_id || ' | text: ' || text AS document_prompt,
  'task: sentence similarity | query: ' || text AS semantic_prompt, lower(text) AS folded FROM benchmark"""


def registered_domains(spark, d):
    pages = table(spark, d, "pages").select("page_id", T.blocking_host("url").alias("host"))
    suffixes = pages.select(F.regexp_extract("host", r"([a-z]+\.[a-z]+)$", 1).alias("suffix"))
    return T.registered_domain(pages, "host", suffixes)


REGISTERED_DOMAINS = f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages)
SELECT page_id, host, regexp_extract(host, '([^.]+\\.[a-z]+\\.[a-z]+)$', 1) AS registered_domain FROM h"""


def numeric_transforms(spark, d):
    x = F.col("l_discount") - 0.05
    some = [F.expr("nullif(l_tax, 0)"), F.expr("nullif(l_discount, 0)"), F.expr("nullif(l_linenumber, 3) / 10")]
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.log1p("l_quantity"), 6).alias("log_quantity"),
        F.round(F.asinh("l_quantity"), 6).alias("asinh_quantity"),
        F.round(log1p_signed(x), 6).alias("signed_log"),
        F.round(rank_outcome(F.col("l_linenumber")) + 0.0, 6).alias("outcome"),
        F.round(row_mean(some), 6).alias("mean_present"),
        all_present(some).alias("all_present"),
        any_present(some).alias("any_present"),
        VX.logistic(F.col("l_quantity") / 10).alias("logistic"),
    )


NUMERIC_TRANSFORMS = """WITH x AS (SELECT *, nullif(l_tax, 0) AS a, nullif(l_discount, 0) AS b, nullif(l_linenumber, 3) / 10 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(l_quantity + 1), 6) AS log_quantity,
  round(asinh(l_quantity), 6) AS asinh_quantity,
  round(sign(l_discount - 0.05) * ln(1 + abs(l_discount - 0.05)), 6) AS signed_log,
  round(-ln(l_linenumber) + 0.0, 6) AS outcome,
  round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) /
    nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS mean_present,
  a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS all_present,
  a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL AS any_present,
  round(1 / (1 + exp(-l_quantity / 10)), 6) AS logistic FROM x"""


def array_functions(spark, d):
    words = F.split("text", " ")
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.size(F.array_distinct(words)).cast("bigint").alias("distinct_words"),
        F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(words, F.lower))), 1, 3), "|").alias("first_words"),
        F.size(F.coalesce(F.when(F.col("role") == "user", words), F.expr("array()"))).cast("bigint").alias("user_words"),
    )


ARRAY_FUNCTIONS = """SELECT conv_id, turn, CAST(len(list_distinct(string_split(text, ' '))) AS BIGINT) AS distinct_words,
  array_to_string(list_sort(list_distinct(list_transform(string_split(text, ' '), lambda x: lower(x))))[1:3], '|') AS first_words,
  CAST(CASE WHEN role = 'user' THEN len(string_split(text, ' ')) ELSE 0 END AS BIGINT) AS user_words FROM conversations"""


# --- contracts --------------------------------------------------------------

_CONTRACT = quality.Contract(
    unique=("l_orderkey", "l_linenumber"),
    non_null=("l_partkey", "score"),
    bounds={"l_quantity": (5, 45), "l_tax": (None, 0.07)},
)


def contract_report(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("*", "if(l_linenumber = 7, NULL, l_discount) AS score")
    return quality.contract_report(rows, _CONTRACT)


CONTRACT_REPORT = """SELECT 'non_null' AS rule, 'l_partkey' AS subject, count(*) - count(l_partkey) AS violations FROM lineitem
UNION ALL SELECT 'non_null', 'score', count(*) FILTER (l_linenumber = 7) FROM lineitem
UNION ALL SELECT 'minimum', 'l_quantity', count(*) FILTER (l_quantity < 5) FROM lineitem
UNION ALL SELECT 'maximum', 'l_quantity', count(*) FILTER (l_quantity > 45) FROM lineitem
UNION ALL SELECT 'maximum', 'l_tax', count(*) FILTER (l_tax > 0.07) FROM lineitem
UNION ALL SELECT 'unique', 'l_orderkey,l_linenumber', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"""


def duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEYS = "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def null_report(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("nullif(l_tax, 0) AS l_tax", "nullif(l_discount, 0) AS l_discount", "l_quantity")
    return quality.null_counts(rows, ["l_tax", "l_discount", "l_quantity"])


NULL_REPORT = """SELECT 'l_tax' AS column_name, count(*) FILTER (l_tax = 0) AS null_count FROM lineitem
UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount = 0) FROM lineitem
UNION ALL SELECT 'l_quantity', CAST(0 AS BIGINT)"""


def bound_report(spark, d):
    return quality.bound_report(table(spark, d, "part"), quality.depth_bounds({"p_size": (10, 40), "p_retailprice": (None, 1500.0)}, 20))


BOUND_REPORT = """SELECT 'p_size' AS column_name, count(*) FILTER (p_size < 10) AS below, count(*) FILTER (p_size > 40) AS above FROM part
UNION ALL SELECT 'p_retailprice', CAST(0 AS BIGINT), count(*) FILTER (p_retailprice > 1500) FROM part"""


def join_key_check(spark, d):
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return quality.join_keeps_rows(left, right, ["k"])


JOIN_KEY_CHECK = """SELECT (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS left_duplicates,
  (SELECT count(*) - count(DISTINCT c_custkey) FROM customer) AS right_duplicates,
  (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) = 0 AND (SELECT count(*) - count(DISTINCT c_custkey) FROM customer) = 0 AS keys_unique"""


def control_issues(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("nullif(l_tax, 0) AS site_scale", "l_discount AS fine")
    return quality.control_issues(rows, ["site_scale", "fine", "authority_proxy"])


CONTROL_ISSUES = """SELECT 'site_scale' AS column_name, 'missing_values' AS reason WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_tax = 0)
UNION ALL SELECT 'authority_proxy', 'missing_column'"""


def panel_guardrails(spark, d):
    report = quality.panel_guardrails(st.panel(spark, d), ["l_discount", "l_tax"], key="keyword_id")
    return report.withColumn("value", F.round("value", 6))


PANEL_GUARDRAILS = f"""WITH {st.PANEL}, v AS (SELECT keyword_id, coalesce(var_pop(serp_rank), 0) AS r,
  coalesce(var_pop(l_discount), 0) AS a, coalesce(var_pop(l_tax), 0) AS b FROM panel GROUP BY 1),
m AS (SELECT min(r) AS r, least(min(a), min(b)) AS s FROM v)
SELECT 'rank_variance_within_keyword' AS guardrail, round(r, 6) AS value, CASE WHEN r > 0 THEN 'pass' ELSE 'hard_fail' END AS status FROM m
UNION ALL SELECT 'score_variance_within_keyword', round(s, 6), CASE WHEN s > 0 THEN 'pass' ELSE 'warn' END FROM m"""


def version_report(spark, d):
    rows = table(spark, d, "orders").selectExpr("if(o_orderstatus = 'O', 'v2', if(o_orderstatus = 'P', NULL, 'v1')) AS schema_version")
    return quality.schema_versions(rows, "v2")


VERSION_REPORT = """SELECT CASE o_orderstatus WHEN 'O' THEN 'v2' WHEN 'P' THEN NULL ELSE 'v1' END AS schema_version, count(*) AS row_count,
  max(o_orderstatus) <> 'O' AS stale FROM orders GROUP BY 1"""


# Rules of each kind for the host names of the given tables and for others.
SUFFIX_RULES = (
    "com", "net", "org", "uk", "co.uk", "*.ck", "!www.ck", "*.example.com", "!thther.example.com", "!ththan.example.com",
    "example.net", "*.example.org", "!tionble.example.org", "!ththon.example.org",
)


def public_suffixes(spark, d):
    """Registered domains of all page hosts by plain, wildcard and exception rules."""
    pages = table(spark, d, "pages").select("page_id", T.blocking_host("url").alias("host"))
    rules = suffixes.parsed_rules(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "value string"))
    return suffixes.attach_registered_domain(pages, "host", rules)


PUBLIC_SUFFIXES = f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
r AS (SELECT rule, ltrim(ltrim(rule, '!'), '*') AS name, starts_with(rule, '!') AS exception, len(string_split(rule, '.')) AS n
  FROM (VALUES {", ".join(f"('{r}')" for r in SUFFIX_RULES)}) t(rule)),
m AS (SELECT host, coalesce(max(CASE WHEN exception THEN n - 1 END), max(n), 1) AS n
  FROM (SELECT DISTINCT host FROM h) LEFT JOIN r ON CASE WHEN rule LIKE '*%' THEN len(host) > len(name) AND ends_with(host, name) ELSE ends_with('.' || host, '.' || name) END
  GROUP BY host)
SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -n, -1), '.') AS public_suffix,
  CASE WHEN len(string_split(host, '.')) > n THEN array_to_string(list_slice(string_split(host, '.'), -n - 1, -1), '.') END AS registered_domain FROM h LEFT JOIN m USING (host)"""


def metric_coverage(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("nullif(l_tax, 0) AS l_tax", "nullif(l_discount, 0) AS l_discount")
    return quality.metric_coverage(rows, ["l_tax", "l_discount"])


METRIC_COVERAGE = """SELECT 'l_tax' AS column_name, count(*) AS row_count, count(nullif(l_tax, 0)) AS non_null_count, count(*) - count(nullif(l_tax, 0)) AS null_count FROM lineitem
UNION ALL SELECT 'l_discount', count(*), count(nullif(l_discount, 0)), count(*) - count(nullif(l_discount, 0)) FROM lineitem"""


def catalog_by_partition(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderstatus AS endpoint", "o_custkey AS response_id", "'raw_responses.v1' AS schema_version", "o_totalprice")
    return dataset_catalog(rows, ["endpoint"]).drop("content_xor", "content_sum")


CATALOG_BY_PARTITION = """SELECT o_orderstatus AS endpoint, 'raw_responses.v1' AS schema_version, count(*) AS row_count,
  count(DISTINCT o_custkey) AS source_response_count FROM orders GROUP BY 1"""


def catalog_of_files(spark, d):
    """Digests and sources from files; the same rows in fewer files have the same digest."""
    root = f"{ensure_checkpoint_dir(spark)}/cataloged-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").selectExpr("o_orderstatus AS endpoint", "o_custkey AS response_id", "o_orderkey", "o_totalprice")
    rows.repartition(3).write.partitionBy("endpoint").parquet(f"{root}/first")
    spread = spark.read.parquet(f"{root}/first")
    spread.repartition(1, "endpoint").write.partitionBy("endpoint").parquet(f"{root}/second")
    before, after = (
        sinks.merged_catalog(sinks.file_catalog(spark.read.parquet(f"{root}/{n}"), ["endpoint"]), ["endpoint"]) for n in ("first", "second")
    )
    same = after.select("endpoint", F.struct("row_count", "content_xor", "content_sum").alias("after"), F.col("file_count").alias("files_left"))
    sources = sinks.source_responses(spread, ["endpoint"]).groupBy("endpoint").agg(F.count_distinct("response_id").alias("source_responses"))
    return (
        before.join(same, "endpoint")
        .join(sources, "endpoint")
        .select("endpoint", "row_count", "source_responses", "files_left", (F.struct("row_count", "content_xor", "content_sum") == F.col("after")).alias("equal_after_compaction"))
    )


CATALOG_OF_FILES = """SELECT o_orderstatus AS endpoint, count(*) AS row_count, count(DISTINCT o_custkey) AS source_responses,
  CAST(1 AS BIGINT) AS files_left, true AS equal_after_compaction FROM orders GROUP BY 1"""


# --- vectors ----------------------------------------------------------------


def centroid_cosine(spark, d):
    """Cosine of every vector to the mean vector of its label."""
    vectors = table(spark, d, "embeddings")
    spread = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = spread.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # At most one entry per dimension and label: the vector length bounds the list.
    centroid = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centroid")
    )
    return vectors.join(centroid, "label").select("vec_id", "label", VX.cosine(F.col("embedding"), F.col("centroid"), 4).alias("similarity"))


CENTROID_COSINE = """WITH s AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM s GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM m GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 4) AS similarity FROM embeddings JOIN c USING (label)"""


def rule_vectors(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        VX.cosine(VX.rule_vector(t), VX.rule_vector(F.lit("crawling"))).alias("plain"),
        VX.cosine(VX.rule_semantic_vector(t), VX.rule_semantic_vector(F.lit("canonical"))).alias("semantic"),
    )


RULE_VECTORS = """SELECT doc_id, CASE WHEN contains(lower(text), 'technical seo') OR contains(lower(text), 'crawling') THEN 1.0
  WHEN contains(lower(text), 'index') OR contains(lower(text), 'canonical') THEN round(1 / sqrt(2.0), 6) ELSE 0.0 END AS plain,
  CASE WHEN contains(lower(text), 'technical seo') OR contains(lower(text), 'crawling') THEN 0.6
  WHEN contains(lower(text), 'index') OR contains(lower(text), 'canonical') THEN 1.0 ELSE 0.8 END AS semantic FROM documents"""


def top_similar(spark, d):
    """The three vectors of each label closest to its first vector."""
    vectors = table(spark, d, "embeddings")
    anchor = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    scored = vectors.join(anchor, "label").select("label", "vec_id", VX.cosine(F.col("embedding"), F.col("anchor"), 4).alias("similarity"))
    return top_per_key(scored, ["label"], [F.col("similarity").desc(), F.col("vec_id").asc()], 3, "position")


TOP_SIMILAR = """WITH a AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1),
s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 4) AS similarity FROM embeddings JOIN a USING (label))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS position FROM s) WHERE position <= 3"""


QUERIES = {
    "unblocked_scores": (unblocked_scores, UNBLOCKED_SCORES),
    "depth_expansion": (depth_expansion, DEPTH_EXPANSION),
    "rank_depth": (rank_depth, RANK_DEPTH),
    "blocked_domains": (blocked_domains, BLOCKED_DOMAINS),
    "blocklist_entries": (blocklist_entries, BLOCKLIST_ENTRIES),
    "complete_controls": (complete_controls, COMPLETE_CONTROLS),
    "keyword_view": (keyword_view, KEYWORD_VIEW),
    "null_backfill": (null_backfill, NULL_BACKFILL),
    "pages_missing_analysis": (pages_missing_analysis, PAGES_MISSING_ANALYSIS),
    "url_functions": (url_functions, URL_FUNCTIONS),
    "paragraphs": (paragraphs, PARAGRAPHS),
    "overlap_score": (overlap, OVERLAP),
    "prompts": (prompts, PROMPTS),
    "registered_domains": (registered_domains, REGISTERED_DOMAINS),
    "public_suffixes": (public_suffixes, PUBLIC_SUFFIXES),
    "numeric_transforms": (numeric_transforms, NUMERIC_TRANSFORMS),
    "array_functions": (array_functions, ARRAY_FUNCTIONS),
    "contract_report": (contract_report, CONTRACT_REPORT),
    "duplicate_keys": (duplicate_keys, DUPLICATE_KEYS),
    "null_report": (null_report, NULL_REPORT),
    "bound_report": (bound_report, BOUND_REPORT),
    "join_key_check": (join_key_check, JOIN_KEY_CHECK),
    "control_issues": (control_issues, CONTROL_ISSUES),
    "panel_guardrails": (panel_guardrails, PANEL_GUARDRAILS),
    "version_report": (version_report, VERSION_REPORT),
    "metric_coverage": (metric_coverage, METRIC_COVERAGE),
    "catalog_by_partition": (catalog_by_partition, CATALOG_BY_PARTITION),
    "catalog_of_files": (catalog_of_files, CATALOG_OF_FILES),
    "centroid_cosine": (centroid_cosine, CENTROID_COSINE),
    "rule_vectors": (rule_vectors, RULE_VECTORS),
    "top_similar": (top_similar, TOP_SIMILAR),
}
