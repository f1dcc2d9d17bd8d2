"""Ranked panels and stored responses derived from the given tables.

The given tables hold no ranked result lists, so the operators run on stand-ins:
suppliers act as keywords, their line items as ranked results and parts as pages.
Every response body is built row by row, so no group is ever collected.  Each
stand-in has the same definition in SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.groups import group_row_number
from rankloom.operators.merge import build_records
from rankloom.session import cut_lineage, store_columns

RUN = "run-1"
DEPTH = 20
#: A supplier has fewer lists than this; list numbers are supplier * LISTS + n.
LISTS = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Deal rows over all cores before JSON work; the files of the given tables are few."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


# --- panels -----------------------------------------------------------------


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists of at most ``DEPTH`` rows over all line items.

    A supplier's line items by price, dearest first, fill one list after another.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"),
        F.col("l_partkey").alias("url_id"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )
    order = [F.col("l_extendedprice").desc(), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "url_id")]]
    numbered = group_row_number(rows, ["supplier"], order, "place")
    return numbered.select(
        (F.col("supplier") * LISTS + F.floor((F.col("place") - 1) / DEPTH)).cast("bigint").alias("keyword_id"),
        *[c for c in rows.columns if c != "supplier"],
        ((F.col("place") - 1) % DEPTH + 1).cast("bigint").alias("serp_rank"),
    )


PANEL = f"""panel AS (
  SELECT CAST(supplier * {LISTS} + (place - 1) // {DEPTH} AS BIGINT) AS keyword_id, url_id, l_orderkey, l_linenumber, l_quantity,
         l_extendedprice, l_discount, l_tax, CAST((place - 1) % {DEPTH} + 1 AS BIGINT) AS serp_rank
  FROM (
    SELECT l_suppkey AS supplier, l_partkey AS url_id, l_orderkey, l_linenumber, l_quantity,
           l_extendedprice, l_discount, l_tax,
           row_number() OVER (PARTITION BY l_suppkey
             ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place
    FROM lineitem))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items with supplier as keyword and a few missing scores."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit(RUN).alias("run_id"),
        F.col("l_suppkey").alias("keyword_id"),
        F.col("l_partkey").alias("url_id"),
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("score_a"),
        F.when(F.col("l_linenumber") != 6, F.col("l_discount")).alias("score_b"),
        "l_tax",
        "l_quantity",
    )


LINES = f"""lines AS (
  SELECT '{RUN}' AS run_id, l_suppkey AS keyword_id, l_partkey AS url_id, l_orderkey,
         CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS score_a,
         CASE WHEN l_linenumber <> 6 THEN l_discount END AS score_b, l_tax, l_quantity
  FROM lineitem)"""


# --- curated stand-ins ------------------------------------------------------


def serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated ranked items: the panel with URLs on 97 hosts."""
    return _with_texts(panel(spark, sf_dir))


def _with_texts(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        f"'{RUN}' AS run_id",
        "concat('k', keyword_id) AS target_keyword_id",
        "concat('supplier ', keyword_id) AS target_keyword",
        "concat('r', l_orderkey) AS response_id",
        "concat(l_orderkey, '-', l_linenumber, '-', url_id, '-', keyword_id) AS serp_item_id",
        "concat('h', url_id) AS canonical_url_hash",
        "concat('https://www.shop', url_id % 97, '.example.com/p/', url_id) AS url",
        "serp_rank",
        "concat('part ', url_id) AS title",
        "'' AS description",
        "'curated.v1' AS schema_version",
        "l_discount",
        "l_tax",
        "l_quantity",
    )


SERP = f"""{PANEL}, serp AS (
  SELECT '{RUN}' AS run_id, 'k' || keyword_id AS target_keyword_id, 'supplier ' || keyword_id AS target_keyword,
         'r' || l_orderkey AS response_id,
         l_orderkey || '-' || l_linenumber || '-' || url_id || '-' || keyword_id AS serp_item_id,
         'h' || url_id AS canonical_url_hash,
         'https://www.shop' || (url_id % 97) || '.example.com/p/' || url_id AS url, serp_rank,
         'part ' || url_id AS title, '' AS description, 'curated.v1' AS schema_version,
         l_discount, l_tax, l_quantity
  FROM panel)"""

_PAGE_SCORES = """max(l_discount) AS bge_raw_score, max(l_discount) AS bge_normalized_score,
  max(l_tax) AS gemini_doc_retrieval_raw_score, max(l_tax) AS gemini_doc_retrieval_normalized_score,
  max(l_quantity) AS gemini_semantic_similarity_raw_score,
  max(l_quantity) / 100 AS gemini_semantic_similarity_normalized_score"""


def _with_parts(spark: SparkSession, sf_dir: str, frame: DataFrame) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("canonical_url_hash", F.concat(F.lit("h"), F.col("p_partkey")))
    return frame.join(part, "canonical_url_hash", "inner")


def curated(spark: SparkSession, sf_dir: str, stored: bool = False) -> dict[str, DataFrame]:
    """Curated tables for the mart builders; pages whose part size is a multiple of 11 have no text.

    ``stored`` writes the numbers of the panel and the pages with their parts once as columns, for queries that read
    pages or signals more than once; the texts of an item follow from its numbers and are made again by every reader.
    ``dealt_items`` are the ranked items, then dealt out by keyword (see ``marts.by_list``) before they get their texts.
    """
    if stored:
        numbers = store_columns(panel(spark, sf_dir).drop("l_extendedprice"))
        items, dealt = _with_texts(numbers), _with_texts(numbers.repartition(F.expr("concat('k', keyword_id)")))
    else:
        items = dealt = cut_lineage(serp(spark, sf_dir))  # read by five branches
    base = items.drop("l_discount", "l_tax", "l_quantity")
    keys = ["run_id", "target_keyword_id", "target_keyword", "canonical_url_hash", "url"]
    scores = dealt.groupBy(*keys).agg(
        *[
            F.expr(e)
            for e in (
                "max(l_discount) AS bge_raw_score",
                "max(l_discount) AS bge_normalized_score",
                "max(l_tax) AS gemini_doc_retrieval_raw_score",
                "max(l_tax) AS gemini_doc_retrieval_normalized_score",
                "max(l_quantity) AS gemini_semantic_similarity_raw_score",
                "max(l_quantity) / 100 AS gemini_semantic_similarity_normalized_score",
            )
        ]
    )
    pages = _with_parts(spark, sf_dir, items.select(*keys).distinct()).where("p_size % 11 <> 0")
    if stored:
        pages = store_columns(pages)
    keywords = (
        base.select("run_id", "target_keyword_id", "target_keyword")
        .distinct()
        .selectExpr("*", "'seed' AS source_seed", "'resp' AS source_response_id", "1L AS keyword_order", "'curated.v1' AS schema_version")
    )
    page_rows = pages.selectExpr(
        *keys,
        "concat(target_keyword_id, '-', p_partkey) AS page_id",
        "concat('pr', p_partkey) AS response_id",
        "p_name AS title",
        "concat(p_name, ' ', p_brand, ' ', p_type) AS text",
        "'curated.v1' AS schema_version",
    )
    onpage = pages.where("p_size % 13 <> 0").selectExpr(
        *keys,
        "CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) * 1000 END AS images_size",
        "CAST(p_size AS BIGINT) * 10 + p_partkey % 5 AS scripts_size",
        "CAST(p_size AS BIGINT) * 3 AS stylesheets_size",
        "p_partkey % 1000 AS total_transfer_size",
        "CAST(p_size AS BIGINT) + p_partkey % 10 AS total_dom_size",
        "p_partkey % 37 AS internal_links_count",
        "CAST(p_size AS BIGINT) * 7 AS time_to_first_byte_ms",
        "p_retailprice AS largest_contentful_paint_ms",
        "p_size % 2 = 0 AS is_https",
        "p_size % 3 = 0 AS canonical",
        "p_size % 5 = 0 AS no_title",
        "p_type = 'SMALL' AS deprecated_html_tags",
        "p_retailprice / 1000 AS meta_keywords_to_content_consistency",
        "'curated.v1' AS schema_version",
    )
    return {
        "keywords": keywords,
        "serp_items": base,
        "dealt_items": dealt.drop("l_discount", "l_tax", "l_quantity"),
        "pages": page_rows,
        "similarity_scores": scores,
        "onpage_signals": onpage,
    }


CURATED = f"""{SERP}, keywords AS (
  SELECT DISTINCT run_id, target_keyword_id, target_keyword, 'seed' AS source_seed, 'resp' AS source_response_id,
         CAST(1 AS BIGINT) AS keyword_order FROM serp),
scores AS (
  SELECT run_id, target_keyword_id, target_keyword, canonical_url_hash, url, {_PAGE_SCORES}
  FROM serp GROUP BY ALL),
page_base AS (
  SELECT s.*, p.* FROM (SELECT DISTINCT run_id, target_keyword_id, target_keyword, canonical_url_hash, url FROM serp) s
  JOIN part p ON s.canonical_url_hash = 'h' || p.p_partkey WHERE p.p_size % 11 <> 0),
pages_t AS (
  SELECT run_id, target_keyword_id, target_keyword, canonical_url_hash, url,
         target_keyword_id || '-' || p_partkey AS page_id, 'pr' || p_partkey AS response_id, p_name AS title,
         p_name || ' ' || p_brand || ' ' || p_type AS text FROM page_base),
onpage AS (
  SELECT run_id, target_keyword_id, target_keyword, canonical_url_hash, url,
         CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) * 1000 END AS images_size,
         CAST(p_size AS BIGINT) * 10 + p_partkey % 5 AS scripts_size,
         CAST(p_size AS BIGINT) * 3 AS stylesheets_size, p_partkey % 1000 AS total_transfer_size,
         CAST(p_size AS BIGINT) + p_partkey % 10 AS total_dom_size, p_partkey % 37 AS internal_links_count,
         CAST(p_size AS BIGINT) * 7 AS time_to_first_byte_ms, p_retailprice AS largest_contentful_paint_ms,
         p_size % 2 = 0 AS is_https, p_size % 3 = 0 AS canonical, p_size % 5 = 0 AS no_title,
         p_type = 'SMALL' AS deprecated_html_tags, p_retailprice / 1000 AS meta_keywords_to_content_consistency
  FROM page_base WHERE p_size % 13 <> 0)"""


# --- stored responses -------------------------------------------------------

_ISO = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"


def serp_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking response per line item, with rows that must be skipped.

    In document order: organic, paid, organic with a boolean rank, organic,
    organic without a text URL, organic.  Line number 7 has a failed task.
    """
    item = "'{\"type\":\"organic\",\"rank_group\":'"
    body = f"""concat('{{"status_code":20000,"tasks":[{{"id":"t', l_orderkey, '-', l_linenumber,
      '","status_code":', if(l_linenumber = 7, 40501, 20000), ',"result":[{{"items":[',
      {item}, l_linenumber, ',"url":"http://www.shop', l_partkey % 50, '.example.com/p/', l_partkey,
         '?utm_source=x&q=', l_suppkey, '#f","title":"part ', l_partkey, '"',
         if(l_linenumber % 2 = 0, ',"description":null', concat(',"description":"line ', l_linenumber, '"')), '}},',
      '{{"type":"paid","rank_group":1,"url":"http://ads.example.com","title":"ad"}},',
      {item}, 'true,"url":"http://bool.example.com","title":"b"}},',
      {item}, l_linenumber + 1, ',"url":"https://m.shop', l_suppkey, '.example.net/o/', l_orderkey, '","title":"order ', l_orderkey, '"}},',
      {item}, '4,"url":5,"title":"n"}},',
      {item}, l_linenumber + 3, ',"url":"https://last.example.org/', l_partkey, '","title":"last"}}',
      ']}}]}}]}}')"""
    rows = spread(table(spark, sf_dir, "lineitem")).selectExpr(
        "concat('Supplier ', l_suppkey) AS target_keyword",
        f"{_ISO.format('l_shipdate')} AS timestamp",
        f"{body} AS body_json",
        "'{}' AS metadata_json",
    )
    return build_records(rows, RUN, "serp", "search")


def onpage_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two on-page responses per part; the newer one has no score if the size is a multiple of 5."""
    body = """concat('{"tasks":[{"id":', p_partkey, ',"result":[{"items":[{"url":"https://shop.example.com/p/', p_partkey,
      '?gclid=', v, '","onpage_score":', if(v = 1 AND p_size % 5 = 0, 'null', concat(p_size, '.5')),
      ',"checks":{"is_https":', p_size % 2 = 0, ',"no_title":1,"title_too_long":"yes","canonical":', p_size % 3 = 0,
      '},"has_micromarkup":', p_size % 4 = 0, ',"from_sitemap":true,',
      '"meta":{"title_length":', p_size, ',"description_length":12.9,"images_size":', p_size * 100 + v,
      ',"internal_links_count":"7","follow":', p_size % 2 = 1, ',"duplicate_meta_tags":["a","b"],"htags":{"h1":["x"],"h2":[]},',
      '"social_media_tags":{"og:title":"x"},"content":{"plain_text_word_count":', p_size * 10,
      ',"plain_text_rate":true},"cumulative_layout_shift":', if(p_size % 3 = 0, 'null', '0.25'),
      '},"page_timing":{"waiting_time":', p_size * 3, ',"largest_contentful_paint":', p_size * 2, '.5,"cumulative_layout_shift":0.5},',
      '"cache_control":{"cachable":true,"ttl":', p_size, '},"resource_errors":{"errors":null,"warnings":[1,2]},',
      '"broken_links":false,"encoded_size":', p_partkey, ',"total_dom_size":null}]}]}]}')"""
    rows = (
        spread(table(spark, sf_dir, "part"))
        .withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
        .selectExpr(
            "p_brand AS target_keyword",
            "concat('2024-01-0', v + 1, 'T00:00:00') AS timestamp",
            f"{body} AS body_json",
            "concat('{\"url\":\"https://shop.example.com/p/', p_partkey, '?gclid=', v, '\"}') AS metadata_json",
        )
    )
    return build_records(rows, RUN, "onpage_instant_pages", "crawl")


def backlinks_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and dofollow responses per order.

    Orders ending in 3 have the old count-only shape, those ending in 4 an empty
    success, those ending in 5 a text metric; dofollow exists for status F.
    """
    orders = spread(table(spark, sf_dir, "orders"))
    head = """'{"url":"https://www.shop', o_custkey, '.example.com/o/', o_orderkey, '","tasks":[{"id":"b', o_orderkey, '",'"""
    summary = f"""concat({head}, CASE o_orderkey % 10
      WHEN 3 THEN concat('"result":[{{"total_count":', o_custkey, ',"items_count":2}}]')
      WHEN 4 THEN '"result_count":0,"result":null'
      WHEN 5 THEN '"result":[{{"target":"x","backlinks":"many","referring_domains":1}}]'
      ELSE concat('"result":[{{"target":"x","backlinks":', o_custkey, ',"referring_domains":', o_orderkey % 100,
        ',"rank":', o_orderkey % 500, ',"info":{{"target_spam_score":', o_orderkey % 50,
        '}},"first_seen":"2020","crawled_pages":null,"referring_links_types":{{"z":', o_custkey, ',"a":1}}}}]') END, '}}]}}')"""
    dofollow = f"""concat({head}, '"result":[{{"target":"x","backlinks":', o_custkey % 7, '}}]}}]}}')"""
    common = ["concat('Segment ', o_orderpriority) AS target_keyword", f"{_ISO.format('o_orderdate')} AS timestamp"]
    a = build_records(
        orders.selectExpr(*common, f"{summary} AS body_json", "'{\"variant\":\"summary\"}' AS metadata_json"),
        RUN,
        "backlinks_summary",
        "links",
    )
    b = build_records(
        orders.where("o_orderstatus = 'F'").selectExpr(*common, f"{dofollow} AS body_json", "'{}' AS metadata_json"),
        RUN,
        "backlinks_dofollow_summary",
        "links",
    )
    return a.unionByName(b)


def expansion_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyword list per customer: segment, the segment in lower case, a number, name, nation."""
    body = """concat('{"tasks":[{"result":[{"keyword":" ', c_mktsegment, '"},{"keyword":"', lower(c_mktsegment),
      '"},{"keyword":5},{"keyword":"', c_name, '"},{"keyword":"nation ', c_nationkey, '"}]}]}')"""
    rows = spread(table(spark, sf_dir, "customer")).selectExpr(
        "concat('seed ', c_custkey) AS target_keyword", "'2024-01-01T00:00:00' AS timestamp", f"{body} AS body_json", "'{}' AS metadata_json"
    )
    return build_records(rows, RUN, "keyword_expansion", "search")


def text_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page-text response per document in one of three shapes.

    By ``doc_id % 3``: direct text, nested content with one node per line, markdown.
    """
    url = "concat('https://docs.example.com/', source, '/', doc_id, '?utm_medium=m')"
    direct = f"""to_json(named_struct('tasks', array(named_struct('result', array(named_struct(
      'url', {url}, 'title', concat('Doc ', doc_id), 'text', text))))))"""
    nested = f"""to_json(named_struct('tasks', array(named_struct('result', array(named_struct('items', array(named_struct(
      'url', {url}, 'page_content', named_struct('main_topic', array(named_struct('h_title', concat(' Topic ', doc_id),
        'primary_content', transform(split(text, '\\n'), l -> named_struct('text', l)))))))))))))"""
    marked = f"""to_json(named_struct('tasks', array(named_struct('result', array(named_struct('items', array(named_struct(
      'url', {url}, 'page_as_markdown', text))))))))"""
    rows = spread(table(spark, sf_dir, "documents")).selectExpr(
        "concat('lang ', lang) AS target_keyword",
        "'2024-01-01T00:00:00' AS timestamp",
        f"CASE doc_id % 3 WHEN 0 THEN {direct} WHEN 1 THEN {nested} ELSE {marked} END AS body_json",
        "'{}' AS metadata_json",
    )
    return build_records(rows, RUN, "page_text", "crawl")


def html_lake(spark: SparkSession, sf_dir: str, keyword: str = "'web'") -> DataFrame:
    """A page-text response with its HTML for every web page; six of seven pages also have an older failed one (by id).

    ``keyword`` is the SQL expression of the keyword a page was crawled for.
    """
    ok = """to_json(named_struct('status_code', 20000, 'tasks', array(named_struct('status_code', 20000, 'result', array(named_struct(
      'items', array(named_struct('url', url, 'nested', named_struct('html', html)))))))))"""
    failed = """CASE page_id % 7
      WHEN 1 THEN '{"tasks":[{"status_code":50402,"result":null}]}'
      WHEN 2 THEN '{"tasks":[{"status_code":40000,"status_message":"Access Denied by site"}]}'
      WHEN 3 THEN '{"tasks":[{"result":[{"items":[{"page_content":{"a":{"text":"JavaScript is disabled here"}}}]}]}]}'
      WHEN 4 THEN '{"status_code":20000,"tasks":[{"status_code":20000,"result":[{"items":[]}]}]}'
      WHEN 5 THEN '{"tasks":[{"status_code":40400,"result":null}]}'
      WHEN 6 THEN '{"tasks":[{"result":[{"crawl_status":" Timeout "}]}]}' END"""
    stored = [
        spread(table(spark, sf_dir, "pages").where(f"page_id % 7 <> 0 OR {n} = 1")).selectExpr(
            f"{keyword} AS target_keyword",
            f"concat('2024-01-0{n + 1}T00:00:00.', lpad(page_id, 12, '0')) AS timestamp",
            f"{body} AS body_json",
            "to_json(named_struct('url', url)) AS metadata_json",
        )
        for n, body in enumerate((failed, ok))
    ]
    rows = stored[0].unionByName(stored[1])
    return build_records(rows, RUN, "page_text", "crawl")


def entity_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text-analysis response per document; mentions are its capitalised ASCII words.

    Section sizes follow from the whole text.  Every tenth document reports an error.
    """
    names = "regexp_extract_all(text, '[A-Z][a-z]+', 0)"
    mention = """named_struct('entityId', lower(w), 'matchedText', w, 'confidenceScore', length(w),
      'relevanceScore', (length(w) % 10) / 10D, 'type', array(concat('T', length(w) % 3), 'Word'))"""
    token = "named_struct('token', t, 'isGrammar', length(t) % 2 = 0, 'isSpelling', length(t) % 5)"
    body = f"""to_json(named_struct('url', concat('https://docs.example.com/', source, '/', doc_id, '#x'),
      'error', if(doc_id % 10 = 9, 'quota', null),
      'response', named_struct('language', lang,
        'entities', transform({names}, w -> {mention}),
        'topics', if(doc_id % 4 = 0, array(), array(named_struct('score', n_chars / 100000D))),
        'words', transform(split(text, ' '), t -> {token}),
        'relations', if(doc_id % 2 = 0, null, array(named_struct('id', 1))))))"""
    rows = spread(table(spark, sf_dir, "documents")).selectExpr(
        "concat('lang ', lang) AS target_keyword", "'2024-01-01T00:00:00' AS timestamp", f"{body} AS body_json", "'{}' AS metadata_json"
    )
    return build_records(rows, RUN, "entities", "text")


MODEL, DIMENSIONS = "embedder", 64


def embedding_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored page and query vectors: every vector stands for a page, label 0-9 for a keyword."""
    vectors = spread(table(spark, sf_dir, "embeddings"))
    body = "to_json(named_struct('embeddings', array(named_struct('values', transform(embedding, x -> cast(x AS double))))))"
    meta = """to_json(named_struct('role', {role!r}, 'url', {url}, 'input_sha256', sha2({content}, 256),
      'model', '%s', 'output_dimensionality', %d))""" % (MODEL, DIMENSIONS)
    url, text = "concat('https://v.example.com/', vec_id)", "concat('vector ', vec_id)"
    parts = []
    for role, keyword, page, content, rows in (
        ("retrieval_document", "NULL", url, f"concat('title: none | text: ', {text})", vectors),
        ("semantic_page", "NULL", url, f"concat('task: sentence similarity | query: ', {text})", vectors),
        # The first vector of a label speaks for the label.
        ("retrieval_query", "concat('label ', label)", "NULL", "concat('task: search result | query: label ', label)", None),
        ("semantic_query", "concat('label ', label)", "NULL", "concat('task: sentence similarity | query: label ', label)", None),
    ):
        if rows is None:
            rows = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
        built = rows.selectExpr(
            f"CAST({keyword} AS string) AS target_keyword",
            "'2024-01-01T00:00:00' AS timestamp",
            f"{body} AS body_json",
            f"{meta.format(role=role, url=page, content=content)} AS metadata_json",
        )
        parts.append(build_records(built, RUN, "gemini_embeddings", "vectors"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
