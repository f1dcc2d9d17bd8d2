"""Filters on the quality operator's columns, its distances by brute force, and texts without letters."""

import math
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from rankloom.llm import language, quality

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("condition", ["not base_failed", "kept", "n_repeat_words > 0", "word_distance > 0.2", "class_distance < 0.1", "n_words > 100 AND n_dup_lines >= 0"])
def test_quality_under_a_filter(docs, condition):
    judged = quality.judged(docs)
    names = judged.columns
    whole = [dict(zip(names, r)) for r in rows_of(judged)]
    holds = {
        "not base_failed": lambda r: not r["base_failed"],
        "kept": lambda r: r["kept"],
        "n_repeat_words > 0": lambda r: r["n_repeat_words"] > 0,
        "word_distance > 0.2": lambda r: r["word_distance"] is not None and r["word_distance"] > 0.2,
        "class_distance < 0.1": lambda r: r["class_distance"] is not None and r["class_distance"] < 0.1,
        "n_words > 100 AND n_dup_lines >= 0": lambda r: r["n_words"] > 100,
    }[condition]
    assert rows_of(judged.where(condition)) == [tuple(r[n] for n in names) for r in whole if holds(r)]


def distance(counts, shares):
    total = sum(counts)
    if not total:
        return None
    part = lambda p, m: p * math.log2(p / m) if p > 0 else 0.0
    pairs = [(c / total, q) for c, q in zip(counts, shares)]
    return math.sqrt(max(sum(part(p, (p + q) / 2) + part(q, (p + q) / 2) for p, q in pairs) / 2, 0.0))


def classes_of(text):
    letters, upper = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    digit, space, point = (len(regex.findall(p, text)) for p in (r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]"))
    return [letters - upper, upper, digit, space, point, len(text) - letters - digit - space - point]


def test_quality_distances_by_brute_force(spark, docs):
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "½ ² 日本語 # $ " * 60, "ja"), (-4, "the " * 200, None), (-4, "the " * 200, None)], SCHEMA)
    both = docs.unionByName(odd)
    rows = [(r.doc_id, r.text or "", r.lang) for r in both.collect()]
    words, classes = defaultdict(Counter), defaultdict(lambda: [0] * 6)
    for _, text, lang in rows:
        words[lang].update(w.lower() for w in WORD.findall(text))
        classes[lang] = [a + b for a, b in zip(classes[lang], classes_of(text))]
    expected = []
    for doc, text, lang in rows:
        mine, n = Counter(w.lower() for w in WORD.findall(text)), len(WORD.findall(text))
        top = sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:20]
        all_words = sum(words[lang].values())
        shares = [c / all_words for _, c in top]
        counts = [mine[w] for w, _ in top]
        by_word = distance([*counts, n - sum(counts)], [*shares, max(0.0, 1 - sum(shares))]) if n >= 120 else None
        by_class = distance(classes_of(text), [c / sum(classes[lang]) for c in classes[lang]]) if len(text) >= 400 else None
        expected.append((doc, by_class, by_word))
    got = quality.judged(both).select("doc_id", "class_distance", "word_distance", "base_failed", "kept").collect()
    close = lambda x: None if x is None else round(x, 9)
    assert sorted(((r[0], close(r[1]), close(r[2])) for r in got), key=str) == sorted(((d, close(a), close(b)) for d, a, b in expected), key=str)
    for r in got:
        assert r.kept == (not r.base_failed and (r.class_distance or 0.0) <= 0.26 and (r.word_distance or 0.0) <= 0.42)


def test_texts_without_letters_have_no_language(spark, docs):
    odd = spark.createDataFrame([(-1, "½ ² ½", "en"), (-2, "Ⅷ", "en"), (-3, "12 _ #", "en"), (-4, None, "en"), (-5, "", None)], SCHEMA)
    got = language.identified(docs.unionByName(odd)).where(F.col("doc_id") < 0).collect()
    assert len(got) == 5 and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
