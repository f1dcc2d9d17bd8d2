"""Quality rules: a base of simple counts, and divergence from the language.

A document's histogram of character classes and of common words is compared with the
reference of its language by the Jensen-Shannon distance (0 same, 1 disjoint).  References
are sums over all documents of the language; common words are its most frequent ones, the
rest of the words is one class of its own.  Short documents make no reliable histogram, so
each comparison has a length below which it is not made.

Only built-in functions are used.  Every count per document is made within its row; the
references are sums per language and word, partial before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.staging import stored

WORD = r"[^\x20\x09-\x0D]+"
CLASSES = ("lower", "upper", "digit", "space", "point", "other")
COMMON_WORDS = 20


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value evaluated once.

    A function of an array evaluates what it captures once per element, and a column is no
    protection: a filter on the result that Spark pushes down puts the expression back in
    its place.  A variable of a function over an array of one stays a variable.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_names(words: Column) -> Column:
    """64-bit names of the three-word windows, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))


def repeated_words(names: Column) -> Column:
    """Words inside windows that stand twice or more in the text, the first included.

    ``names`` is a variable (see ``held``) of ``window_names``.  Only where a name repeats are
    they sorted with their places, so that equal ones are neighbours (n log n, also for very long texts).
    """

    def counted(ordered: Column) -> Column:
        def again(w: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1)["name"], F.get(ordered, i + 1)["name"]
            return F.coalesce(before == w["name"], F.lit(False)) | F.coalesce(after == w["name"], F.lit(False))

        places = F.transform(F.filter(ordered, again), lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    placed = F.sort_array(F.transform(names, lambda name, i: F.struct(name.alias("name"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), 0).otherwise(held(placed, counted))


def not_letters(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{L}+", "")


def class_counts(text: Column, rest: Column) -> Column:
    """Characters by class, in the order of ``CLASSES``; ``rest`` is the text without its letters."""
    letters = F.length(text) - F.length(rest)
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    counts = [F.length(F.regexp_replace(rest, c, "")) for c in ("[^0-9]+", r"[^\x20\x09-\x0D]+", r"[^.,;:!?'\"()\-]+")]
    return F.array(*[c.cast("double") for c in (letters - upper, upper, *counts, F.length(rest) - counts[0] - counts[1] - counts[2])])


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram and a reference distribution."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def whole(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def distance(share: Column) -> Column:
        both = F.zip_with(share, reference, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
        return F.sqrt(F.greatest(whole(both) / 2, F.lit(0.0)))

    def of(n: Column) -> Column:
        return held(whole(n), lambda total: F.when(total > 0, held(F.transform(n, lambda c: c / total), distance)))

    return held(counts, of)


def references(rows: DataFrame, common: int) -> DataFrame:
    """``language``, ``common`` (words, most frequent first, ties by code point), ``word_share`` (one more entry
    for the rest), ``class_share``; one row per language, null being one.  ``rows``: ``language``, ``text``."""
    counts = rows.select("language", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
    counts = stored(counts, "quality-words")
    best = Window.partitionBy("language").orderBy(F.col("n").desc(), "word")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= common).groupBy("language").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    words = counts.groupBy(F.col("language").alias("in_words")).agg(F.sum("n").cast("double").alias("all_words"))
    classes = rows.withColumn("rest", not_letters(F.col("text"))).select("language", class_counts(F.col("text"), F.col("rest")).alias("classes"))
    totals = classes.groupBy(F.col("language").alias("in_classes")).agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))])
    chars = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    shares = F.transform("top", lambda t: t["n"] / F.col("all_words"))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    both = top.join(words, F.col("language").eqNullSafe(F.col("in_words"))).join(totals, F.col("language").eqNullSafe(F.col("in_classes")))
    return both.select(
        "language", F.transform("top", lambda t: t["word"]).alias("common"), F.concat(shares, F.array(rest)).alias("word_share"), F.array(*[F.col(f"c{i}") / chars for i in range(len(CLASSES))]).alias("class_share")
    )


def common_counts(words: Column, common: Column, most: int) -> Column:
    """How often each common word stands in the text, and the number of all other words.

    Every word becomes one character, its place among the (at most ``most``) common words; a
    character is counted by leaving it out.
    """
    alphabet = "".join(map(chr, range(0x21, 0x22 + most)))  # the first one is for other words
    marks = F.array_join(F.transform(words, lambda w: F.substring(F.lit(alphabet), F.array_position(common, F.lower(w)).cast("int") + 1, F.lit(1))), "")

    def counted(text: Column) -> Column:
        def number(mark: Column) -> Column:
            return (F.length(text) - F.length(F.replace(text, mark, F.lit("")))).cast("double")

        hits = F.transform(common, lambda _, i: number(F.substring(F.lit(alphabet), i + 2, F.lit(1))))
        return F.concat(hits, F.array(number(F.lit(alphabet[0]))))

    return held(marks, counted)


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = COMMON_WORDS,
    least_chars: int = 400,
    least_words: int = 120,
    most_class: float = 0.26,
    most_word: float = 0.42,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``class_distance``, ``word_distance`` (null if not compared), ``kept``.

    Null and empty texts have no words and fail the base.  Null languages share a reference.
    Repeated rows stay, and count as often as they stand.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("language"), text.alias("text"))
    learned = stored(references(rows.select("language", "text"), common), "quality-references")
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("rest", not_letters(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    counted = rows.select(
        "doc_id",
        "language",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("rest", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 4, held(F.col("words"), lambda w: held(window_names(w), repeated_words))).otherwise(0).cast("long").alias("n_repeat_words"),
        class_counts(F.col("text"), F.col("rest")).alias("classes"),
        "words",
        F.length("text").alias("n_chars"),
    )
    counted = counted.withColumn("word_chars", (F.col("n_chars") - F.get("classes", F.lit(CLASSES.index("space")))).cast("long"))
    reference = learned.withColumnRenamed("language", "of")
    both = counted.join(reference, F.col("language").eqNullSafe(F.col("of")), "left")
    both = both.withColumn("word_counts", common_counts(F.col("words"), F.col("common"), common)).drop("words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    by_class = F.when(F.col("n_chars") >= least_chars, divergence(F.col("classes"), F.col("class_share")))
    by_word = F.when(F.col("n_words") >= least_words, divergence(F.col("word_counts"), F.col("word_share")))
    scored = both.withColumn("base_failed", failed).withColumn("class_distance", by_class).withColumn("word_distance", by_word)
    fine = (F.coalesce("class_distance", F.lit(0.0)) <= most_class) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & fine).alias("kept"))
