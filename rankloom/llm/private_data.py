"""Personal data: base patterns, and terms that give a protected value away.

Base matches (e-mail, address, card, phone) are protected.  A term in a document with a
protected value is judged by what the corpus says of it: with documents as events, its
pointwise mutual information with the value is compared with the information of the value
itself.  A term that carries at least ``threshold`` of that information discloses the value
and is generalised wherever it stands, in any document (kind ``term``).  Values count by
what they name, not by their spelling.  Estimates need ``support`` documents in which the
two stand together, so that a single mention proves nothing.  Terms are runs of letters of any length, outside of base matches.

Only built-in functions are used.  Counts are partial sums before every shuffle; a value or
a term found in a third of all rows is one row per task by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.spans import SPAN, count_of, found, joined, ordered
from rankloom.llm.staging import row_key, stored

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "term")

#: Buckets of row keys, and so the most rows of the table of wanted ones that is broadcast.
BUCKETS = 1 << 20

# The base patterns.  A match that begins inside a run of its first class
# could as well begin at the run's start, so other places are skipped (linear time);
# possessive groups keep long matches off the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{M}*+\p{L}[\p{L}\p{M}]*+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(F.length(digits).between(12, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """Valid base matches of a text (null: none), unordered."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(
        found(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        F.filter(found(text, "ip", ADDRESS), lambda s: s["value"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")),
        F.filter(found(text, "card", CARD), lambda s: _luhn(s["value"])),
        F.filter(found(text, "phone", PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    )


def _outside(text: Column, base: Column) -> Column:
    """The text with every base span blanked, code point by code point."""

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], clear, blank).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(ordered(base, KINDS), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def _words(outside: Column) -> Column:
    """Distinct words of a text as they are spelled."""
    return F.array_distinct(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)))


def _terms(outside: Column) -> Column:
    return F.array_distinct(F.transform(_words(outside), lambda w: F.lower(w)))


def _entities(base: Column) -> Column:
    """What the base spans of a text name, whatever the spelling: array of (entity, part).

    An e-mail address names itself in lower case and, as parts that others may share, its
    local part and its domain; cards and phones are their digits, addresses their four numbers.
    """

    def named(kind: str, value: Column, part: bool = False) -> Column:
        return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("entity"), F.lit(part).alias("part"))

    def of(s: Column) -> Column:
        mail = F.lower(s["value"])
        numbers = F.array_join(F.transform(F.split(s["value"], r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), ".")
        return (
            F.when(s["kind"] == "email", F.array(named("email", mail), named("local", F.substring_index(mail, "@", 1), True), named("domain", F.substring_index(mail, "@", -1), True)))
            .when(s["kind"] == "ip", F.array(named("ip", numbers)))
            .otherwise(F.array(named("number", _digits(s["value"]))))
        )

    return F.array_distinct(F.flatten(F.transform(base, of)))


def _near(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key shares a bucket with one of ``keys``: texts of the others need not travel."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    return rows.select("*", bucket).join(F.broadcast(keys.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


def _documents_of_terms(small: DataFrame, rows: DataFrame) -> DataFrame:
    """``term``, ``n_term``: distinct documents with the term.  All rows are counted, and the copies
    of repeated rows taken off again, so that only texts of repeated rows travel."""
    terms = F.explode(_terms(F.col("outside"))).alias("term")
    counts = rows.select(terms).groupBy("term").agg(F.count("*").alias("n_term"))
    repeated = stored(small.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "private-repeated")
    if repeated.isEmpty():
        return counts
    copies = _near(rows, repeated).join(repeated, "key").select("key", terms).groupBy("key", "term").agg((1 - F.count("*")).alias("n_term"))
    return counts.unionByName(copies.select("term", "n_term")).groupBy("term").agg(F.sum("n_term").alias("n_term"))


def disclosing(small: DataFrame, rows: DataFrame, threshold: float, support: int) -> DataFrame:
    """``term``s that reveal an entity: mutual information >= threshold * information of the entity.

    An entity of fewer than ``support`` documents has no pair of that many, so it is left out
    before pairs are made.  A part of an address is met by chance where it is common; its
    estimate is shrunk by ``support`` documents in which the term meets it by chance only.
    """
    entities = small.select("key", F.explode(_entities(F.col("base"))).alias("e")).select("key", "e.entity", "e.part").distinct()
    known = stored(entities.groupBy("entity", "part").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "private-entities")
    holders = entities.join(known.select("entity"), "entity").select("key", "entity")
    words = rows.where(F.size("base") > 0).select("key", _terms(F.col("outside")).alias("terms")).dropDuplicates(["key"])
    both = holders.join(words, "key").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    pairs = stored(both, "disclosure-pairs")
    n = F.lit(float(small.select("key").distinct().count()))
    chance = F.col("n_entity") / n
    unseen = F.when(F.col("part"), F.lit(float(support))).otherwise(0.0)
    mutual = F.log2((F.col("both") + unseen * chance) / (F.col("n_term") + unseen) / chance)
    return pairs.join(known, "entity").join(_documents_of_terms(small, rows), "term").where((chance < 1) & (mutual >= F.lit(threshold) * -F.log2(chance))).select("term").distinct()


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``key``, ``added``: every place of the terms in every text, outside of base spans.

    The distinct words of a text are matched with the terms first; the places are then found
    by one pattern of the spellings that this text has.
    """
    spelled = rows.select("key", F.explode(_words(F.col("outside"))).alias("word")).withColumn("term", F.lower("word")).join(terms, "term")
    hits = stored(spelled.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("word")), "|").alias("words")), "private-hits")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.col("words"), F.lit(r")(?![\p{L}\p{M}])"))
    located = _near(rows.select("key", "outside"), hits).join(hits, "key").select("key", found(F.col("outside"), "term", pattern, F.lit(True)).alias("added"))
    lowered = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lower(s["value"]).alias("value")))
    return located.dropDuplicates(["key"]).select("key", lowered.alias("added"))


def protected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, support: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``key`` (of the row's content) and ``spans``
    (array of start, end, kind, value; ordered), base matches and disclosing terms.

    Null texts are empty.  Repeated rows stay and count as one document.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).withColumn("base", base_spans(F.col("text")))
    small = stored(rows.select("doc_id", "key", "base"), "private")
    rows = rows.select("key", "base", _outside(F.col("text"), F.col("base")).alias("outside"))
    terms = stored(disclosing(small, rows, threshold, support), "disclosing")
    added = occurrences(rows, terms)
    spans = ordered(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))), ALL_KINDS)
    return small.join(added, "key", "left").select("doc_id", "key", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; overlapping spans leave one mark."""

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], clear, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def digest(result: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return result.select(
        "doc_id",
        *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, support: int = 3) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind; all other columns as they are."""
    marked = protected(docs, id_col, text_col, threshold, support).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    marked = stored(marked, "private-marked")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col(id_col).cast("long"), text).alias("key"))
    both = rows.join(marked.hint("shuffle_hash"), "key", "left")
    changed = F.when(F.col("spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(redacted(F.col(f"row.`{text_col}`"), F.col("spans")))
    return both.select(*[(changed if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
