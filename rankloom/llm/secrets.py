"""Secret scan with corpus-wide ownership of every candidate.

Candidates are the values of the base patterns and other long tokens that look drawn (both
letters and digits).  Their hashes are aggregated over the corpus by distinct repositories
and distinct owners.  A value seen at several owners, or in more repositories than an owner's
own credential is used in, is a copied example; any other value that looks drawn is live.  Base spans always stay; live tokens that no base span
covers are added with kind ``owned``.

Aggregations go from (hash, owner, repository) to (hash, owner) to hash, so that a value
found in a third of all rows is summed up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.spans import SPAN, count_of, found, joined, ordered
from rankloom.llm.staging import row_key, stored

KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, "owned")
SPREAD = "array<struct<start:int,end:int,kind:string,owners:bigint,repositories:bigint>>"

# The base patterns.  A run that is too short can be left out of the access
# and hex patterns at once, because no part of such a run is long enough either.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Other tokens that may be credentials.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"


def base_spans(text: Column) -> Column:
    """Base matches of a text (null: none), unordered."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    assign = F.filter(found(text, "assign", ASSIGN), lambda s: F.length(secret_of(s)) >= 12)
    return F.concat(assign, found(text, "access", ACCESS), found(text, "hex", HEX))


def secret_of(span: Column) -> Column:
    """The secret within a span: group 2 of an assignment, else the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 1)).otherwise(span["value"])


def other_tokens(text: Column, base: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    drawn = F.filter(found(text, "owned", TOKEN), lambda t: t["value"].rlike("[0-9]") & t["value"].rlike("[A-Za-z]"))
    return F.filter(drawn, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash``, ``repositories``, ``owners`` from rows (hash, owner, repository); nulls are values of their own."""
    return (
        candidates.groupBy("hash", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("hash")
        .agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", most_owners: int = 1, most_repositories: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``spans`` (array of start, end, kind, value; ordered),
    ``n_live`` and ``n_copied`` (candidates of this row of at most ``most_owners`` owners and
    ``most_repositories`` repositories, or of more of either), and ``spread`` (array of start,
    end, kind, owners, repositories of every candidate; ordered).

    Null texts are empty.  Repositories count within their owner.  Repeated rows stay and
    count once.  Only the named columns are read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(text_col).cast("string").alias("text"),
    )
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("other", other_tokens(F.col("text"), F.col("base")))
    rows = stored(rows.select("doc_id", "repository", "owner", row_key(F.col("doc_id"), F.col("text")).alias("key"), "base", "other"), "secrets")
    single = rows.select("key", "repository", "owner", F.explode(F.concat("base", "other")).alias("span")).select(
        "key", "repository", "owner", "span", F.sha2(secret_of(F.col("span")).cast("binary"), 256).alias("hash")
    )
    owned = stored(ownership(single), "ownership")
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    drawn = secret_of(F.col("span")).rlike("[0-9]") & secret_of(F.col("span")).rlike("[A-Za-z]")
    verdicts = (
        single.dropDuplicates(["key", "hash", "span"])
        .join(owned, "hash")
        .groupBy("key")
        .agg(
            F.collect_list(F.when(few & (F.col("span.kind") == "owned"), F.col("span"))).alias("added"),
            F.count(F.when(few & drawn, 1)).alias("n_live"),
            F.count(F.when(~few, 1)).alias("n_copied"),
            F.array_sort(F.collect_list(F.struct("span.start", "span.end", "span.kind", "owners", "repositories"))).alias("spread"),
        )
    )
    spans = ordered(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))), ALL_KINDS)
    return rows.join(verdicts, "key", "left").select(
        "doc_id",
        spans.alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("spread", F.array().cast(SPREAD)).alias("spread"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return result.select(
        "doc_id",
        *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
        F.array_join(F.transform("spread", lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"], c["owners"], c["repositories"])), ",").alias("spread"),
    )
