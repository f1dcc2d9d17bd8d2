"""Queries for ranks, windows, deduplication and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import ranks
from rankloom.operators.groups import first_per_key, group_percentiles, top_per_key
from rankloom.plans import standins as st
from rankloom.plans.standins import table

KEY = ["run_id", "keyword_id"]
_ID = ["keyword_id", "url_id", "l_orderkey", "l_linenumber"]


def _rounded(frame, columns):
    """Quotients of counts get nine digits: they can end exactly on a half at six."""
    return frame.withColumns({c: F.round(F.col(c) + 0.0, 9 if c.endswith("_pct") else 6) for c in columns})


def ordinal_ranks(spark, d):
    out = ranks.ordinal_ranks(st.lines(spark, d), {"a": "score_a", "b": "score_b"}, KEY, ["l_orderkey", "l_linenumber", "url_id"])
    return _rounded(out, ["a_pct", "a_z", "b_pct", "b_z"]).select(*_ID, "a_rank", "a_pct", "a_z", "b_rank", "b_pct", "b_z")


def _ordinal(name, score):
    n = f"count({score}) OVER k"
    rank = f"row_number() OVER (PARTITION BY keyword_id ORDER BY {score} DESC NULLS LAST, l_orderkey, l_linenumber, url_id)"
    return f"""CASE WHEN {score} IS NOT NULL THEN {rank} END AS {name}_rank,
      CASE WHEN {n} = 1 THEN 0.0 WHEN {score} IS NOT NULL THEN round(({rank} - 1) / ({n} - 1) + 0.0, 9) END AS {name}_pct,
      round(({score} - avg({score}) OVER k) / nullif(stddev_samp({score}) OVER k, 0) + 0.0, 6) AS {name}_z"""


ORDINAL_RANKS = f"""WITH {st.LINES}
SELECT keyword_id, url_id, l_orderkey, l_linenumber, {_ordinal('a', 'score_a')}, {_ordinal('b', 'score_b')}
FROM lines WINDOW k AS (PARTITION BY keyword_id)"""


def average_ranks(spark, d):
    out = ranks.average_ranks(st.lines(spark, d), {"b": "score_b", "q": "l_quantity"}, KEY)
    return _rounded(out, ["b_rank", "b_pct", "b_z", "q_rank", "q_pct", "q_z"]).select(
        *_ID, "b_rank", "b_pct", "b_z", "q_rank", "q_pct", "q_z"
    )


def _average(name, score):
    rank = f"(rank() OVER (PARTITION BY keyword_id ORDER BY {score} DESC NULLS LAST) + (count(*) OVER (PARTITION BY keyword_id, {score}) - 1) / 2.0)"
    n = f"count({score}) OVER k"
    return f"""CASE WHEN {score} IS NOT NULL THEN round({rank} + 0.0, 6) END AS {name}_rank,
      CASE WHEN {score} IS NOT NULL AND {n} > 1 THEN round(({rank} - 1) / ({n} - 1) + 0.0, 9) END AS {name}_pct,
      round(({score} - avg({score}) OVER k) / nullif(stddev_samp({score}) OVER k, 0) + 0.0, 6) AS {name}_z"""


AVERAGE_RANKS = f"""WITH {st.LINES}
SELECT keyword_id, url_id, l_orderkey, l_linenumber, {_average('b', 'score_b')}, {_average('q', 'l_quantity')}
FROM lines WINDOW k AS (PARTITION BY keyword_id)"""


def within_zscore(spark, d):
    orders = table(spark, d, "lineitem").selectExpr("l_orderkey AS target_keyword_id", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return _rounded(ranks.within_group_zscore(orders, "l_discount"), ["similarity_z"])


WITHIN_ZSCORE = """WITH s AS (SELECT l_orderkey, avg(l_discount) AS m, stddev_samp(l_discount) AS sd, min(l_discount) AS lo, max(l_discount) AS hi
  FROM lineitem GROUP BY 1)
SELECT l_orderkey AS target_keyword_id, l_linenumber, l_partkey, l_suppkey, l_discount, round((l_discount - m) / sd + 0.0, 6) AS similarity_z
FROM lineitem JOIN s USING (l_orderkey) WHERE hi > lo"""


def zscore_drops(spark, d):
    orders = table(spark, d, "lineitem").selectExpr("l_orderkey AS target_keyword_id", "l_discount")
    return ranks.dropped_by_zscore(orders, "l_discount")


ZSCORE_DROPS = """WITH s AS (SELECT l_orderkey, count(*) AS n, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1)
SELECT CAST(sum(CASE WHEN hi > lo THEN 0 ELSE n END) AS BIGINT) AS dropped_rows, CAST(sum(n) AS BIGINT) AS total_rows FROM s"""


def run_zscore(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority AS run_id", "ln(o_totalprice + 1) AS size")
    return _rounded(ranks.run_zscore(rows, "size"), ["z"]).select("o_orderkey", "run_id", "z")


RUN_ZSCORE = """WITH x AS (SELECT o_orderkey, o_orderpriority AS run_id, ln(o_totalprice + 1) AS size FROM orders)
SELECT o_orderkey, run_id, round(coalesce((size - avg(size) OVER w) / nullif(stddev_samp(size) OVER w, 0), 0) + 0.0, 6) AS z
FROM x WINDOW w AS (PARTITION BY run_id)"""


def global_zscore(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("size"))
    return _rounded(ranks.global_zscore(rows, "size"), ["z"]).select("doc_id", "z")


GLOBAL_ZSCORE = """SELECT doc_id, round((ln(n_chars + 1) - avg(ln(n_chars + 1)) OVER ()) / stddev_samp(ln(n_chars + 1)) OVER () + 0.0, 6) AS z FROM documents"""


def demeaned(spark, d):
    rows = st.lines(spark, d).withColumns({"score_a": F.ln("score_a"), "l_quantity": F.sqrt("l_quantity")})
    out = ranks.demean(rows, ["score_a", "l_quantity"], ["keyword_id"])
    return _rounded(out, ["l_quantity_within", "score_a_within"]).select(*_ID, "l_quantity_within", "score_a_within")


DEMEANED = f"""WITH {st.LINES} SELECT keyword_id, url_id, l_orderkey, l_linenumber,
  round(sqrt(l_quantity) - avg(sqrt(l_quantity)) OVER k + 0.0, 6) AS l_quantity_within, round(ln(score_a) - avg(ln(score_a)) OVER k + 0.0, 6) AS score_a_within
FROM lines WINDOW k AS (PARTITION BY keyword_id)"""


def suffix_sums(spark, d):
    out = ranks.suffix_sums(st.panel(spark, d), ["l_quantity", "l_discount"], ["keyword_id"])
    return out.select("keyword_id", "serp_rank", "l_quantity_suffix", F.round("l_discount_suffix", 6).alias("l_discount_suffix"))


SUFFIX_SUMS = f"""WITH {st.PANEL} SELECT keyword_id, serp_rank, sum(l_quantity) OVER w AS l_quantity_suffix,
  round(sum(l_discount) OVER w, 6) AS l_discount_suffix
FROM panel WINDOW w AS (PARTITION BY keyword_id ORDER BY serp_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def first_page_rows(spark, d):
    """First row per (keyword, page) by rank, then item."""
    return first_per_key(st.serp(spark, d), ["target_keyword_id", "canonical_url_hash"], [F.col("serp_rank").asc(), F.col("serp_item_id").asc()]).select(
        "target_keyword_id", "canonical_url_hash", "serp_rank", "serp_item_id"
    )


FIRST_PAGE_ROWS = f"""WITH {st.SERP} SELECT target_keyword_id, canonical_url_hash, serp_rank, serp_item_id FROM serp
QUALIFY row_number() OVER (PARTITION BY target_keyword_id, canonical_url_hash ORDER BY serp_rank, serp_item_id) = 1"""


def latest_usable_event(spark, d):
    """Latest event per (user, type) whose payload is usable."""
    events = table(spark, d, "events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    rows = first_per_key(events.where("k >= 50"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("user_id", "event_type", "event_id", "k", "value")


LATEST_USABLE_EVENT = """SELECT user_id, event_type, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events
WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def best_event(spark, d):
    """Best event per user: usable first, then latest."""
    events = table(spark, d, "events").withColumn("usable", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") >= 95)
    best = F.max_by(F.struct("event_id", "usable", "value"), F.struct("usable", "ts", "event_id"))
    return events.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


BEST_EVENT = """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) >= 95 AS usable FROM events)
SELECT user_id, event_id, usable, value FROM e
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY usable DESC, ts DESC, event_id DESC) = 1"""


def group_summary(spark, d):
    """Median, quartiles and same-sign share of a statistic per group."""
    rows = table(spark, d, "customer")
    quartiles = group_percentiles(rows, ["c_mktsegment"], "c_acctbal", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    with_median = rows.join(quartiles, "c_mktsegment")
    return with_median.groupBy("c_mktsegment").agg(
        F.round(F.max("median"), 6).alias("median"),
        F.round(F.max(F.col("q3") - F.col("q1")), 6).alias("iqr"),
        F.round(F.avg((F.signum("c_acctbal") == F.signum("median")).cast("double")), 6).alias("same_sign"),
    )


GROUP_SUMMARY = """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
SELECT c_mktsegment, round(max(m), 6) AS median, round(max(q3 - q1), 6) AS iqr, round(avg(CASE WHEN sign(c_acctbal) = sign(m) THEN 1.0 ELSE 0.0 END), 6) AS same_sign
FROM customer JOIN q USING (c_mktsegment) GROUP BY 1"""


def sd_rms(spark, d):
    per_key = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.var_samp("l_quantity").alias("v"))
    return per_key.agg(F.round(F.sqrt(F.avg("v")), 6).alias("sd_rms"))


SD_RMS = "SELECT round(sqrt(avg(v)), 6) AS sd_rms FROM (SELECT var_samp(l_quantity) AS v FROM lineitem GROUP BY l_orderkey)"


def choice_set_sizes(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    middle = group_percentiles(sizes.withColumn("g", F.lit(1)), ["g"], "n", {"median": 0.5}).select("median")
    return sizes.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("sets")).crossJoin(F.broadcast(middle))


CHOICE_SET_SIZES = """SELECT min(n) AS smallest, max(n) AS largest, count(*) AS sets, median(n) AS median
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"""


def repeat_summary(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        *[F.round(f("o_totalprice"), 3).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lowest", F.min), ("highest", F.max))]
    )


REPEAT_SUMMARY = """SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(stddev_pop(o_totalprice), 3) AS sd,
  round(min(o_totalprice), 3) AS lowest, round(max(o_totalprice), 3) AS highest FROM orders GROUP BY 1"""


def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        (F.count(F.lit(1)) - F.count_distinct("l_orderkey", "l_linenumber")).alias("duplicates"),
    )


DISTINCT_COUNTS = """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem GROUP BY 1"""


def status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("row_count"))


STATUS_COUNTS = "SELECT o_orderstatus, count(*) AS row_count FROM orders GROUP BY 1"


def top_examples(spark, d):
    """Three best-ranked rows per page as parallel arrays."""
    top = top_per_key(st.serp(spark, d), ["canonical_url_hash"], [F.col(c).asc() for c in ("serp_rank", "target_keyword", "serp_item_id")], 3, "position")
    listed = F.array_sort(F.collect_list(F.struct("position", "target_keyword", "serp_rank")))
    return top.groupBy("canonical_url_hash").agg(listed.alias("l")).select(
        "canonical_url_hash",
        F.array_join(F.transform("l", lambda e: e["target_keyword"]), ", ").alias("example_keywords"),
        F.array_join(F.transform("l", lambda e: e["serp_rank"].cast("string")), ", ").alias("example_ranks"),
    )


TOP_EXAMPLES = f"""WITH {st.SERP}, t AS (SELECT *, row_number() OVER (PARTITION BY canonical_url_hash ORDER BY serp_rank, target_keyword, serp_item_id) AS position FROM serp)
SELECT canonical_url_hash, string_agg(target_keyword, ', ' ORDER BY position) AS example_keywords,
  string_agg(CAST(serp_rank AS VARCHAR), ', ' ORDER BY position) AS example_ranks FROM t WHERE position <= 3 GROUP BY 1"""


def sorted_report(spark, d):
    """Marts in retrieval order."""
    return st.serp(spark, d).select("target_keyword_id", "serp_rank", "canonical_url_hash").orderBy("target_keyword_id", "serp_rank", "canonical_url_hash")


SORTED_REPORT = f"WITH {st.SERP} SELECT target_keyword_id, serp_rank, canonical_url_hash FROM serp ORDER BY 1, 2, 3"


def minimum_variance(spark, d):
    per_key = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.var_pop("l_extendedprice").alias("v"), F.var_pop("l_quantity").alias("q"))
    return per_key.agg(F.round(F.coalesce(F.min("q"), F.lit(0.0)), 6).alias("minimum_variance"))


MINIMUM_VARIANCE = "SELECT round(coalesce(min(q), 0), 6) AS minimum_variance FROM (SELECT var_pop(l_quantity) AS q FROM lineitem GROUP BY l_suppkey)"


def score_report(spark, d):
    """Parts of each brand by retail price, some without one."""
    parts = table(spark, d, "part").selectExpr("p_brand", "p_partkey", "if(p_partkey % 9 = 0, NULL, p_retailprice) AS p_retailprice")
    return ranks.score_report(parts, "p_retailprice", ["p_brand"], ["p_partkey"])


SCORE_REPORT = """WITH p AS (SELECT p_brand, p_partkey, p_retailprice FROM part WHERE p_partkey % 9 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM p)
SELECT p_brand, p_partkey, p_retailprice, rank, CASE WHEN n = 1 THEN 0.0 ELSE (rank - 1)::DOUBLE / (n - 1) END AS percentile FROM r"""


QUERIES = {
    "score_report": (score_report, SCORE_REPORT),
    "ordinal_ranks": (ordinal_ranks, ORDINAL_RANKS),
    "average_ranks": (average_ranks, AVERAGE_RANKS),
    "within_zscore": (within_zscore, WITHIN_ZSCORE),
    "zscore_drops": (zscore_drops, ZSCORE_DROPS),
    "run_zscore": (run_zscore, RUN_ZSCORE),
    "global_zscore": (global_zscore, GLOBAL_ZSCORE),
    "demeaned": (demeaned, DEMEANED),
    "suffix_sums": (suffix_sums, SUFFIX_SUMS),
    "first_page_rows": (first_page_rows, FIRST_PAGE_ROWS),
    "latest_usable_event": (latest_usable_event, LATEST_USABLE_EVENT),
    "best_event": (best_event, BEST_EVENT),
    "group_summary": (group_summary, GROUP_SUMMARY),
    "sd_rms": (sd_rms, SD_RMS),
    "choice_set_sizes": (choice_set_sizes, CHOICE_SET_SIZES),
    "repeat_summary": (repeat_summary, REPEAT_SUMMARY),
    "distinct_counts": (distinct_counts, DISTINCT_COUNTS),
    "status_counts": (status_counts, STATUS_COUNTS),
    "top_examples": (top_examples, TOP_EXAMPLES),
    "sorted_report": (sorted_report, SORTED_REPORT),
    "minimum_variance": (minimum_variance, MINIMUM_VARIANCE),
}
