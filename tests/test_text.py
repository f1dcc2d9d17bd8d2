"""Text and URL functions against the standard library."""

import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import vectors as VX

URLS = [
    "http://A.com/x?utm_source=feed&b=1 2&c=&GCLID=4#t",
    "https://m.x.net/en/25#top",
    "HTTPS://user@www.x.co:80/a%20b?q=%C3%A9~*&d&&e=a%2Bb+c",
    "https://e.com/?UTM_x=1",
    "https://e.com/p?x=100%&y=%zz",
    "no scheme/path?fbclid=1&k=v",
    "https://e.com/a?x=1?y=2",
]


def identity(url):
    p = urllib.parse.urlsplit(url)
    drop = {"srsltid", "gclid", "dclid", "msclkid", "fbclid", "gbraid", "wbraid"}
    pairs = urllib.parse.parse_qsl(p.query, keep_blank_values=True)
    kept = [(k, v) for k, v in pairs if k.lower() not in drop and not k.lower().startswith("utm_")]
    return urllib.parse.urlunsplit((p.scheme, p.netloc, p.path, urllib.parse.urlencode(kept), ""))


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("o")).first()["o"]


@pytest.mark.parametrize("url", URLS)
def test_canonical_url(spark, url):
    assert one(spark, url, T.canonical_url("t")) == identity(url)


@pytest.mark.parametrize(
    "text, words",
    [("l'été-ça va bien", 3), ("--- ' a_b", 1), ("don't -stop- 42", 3), ("", 0), ("über straße ñ", 3), ("a--b 'x' -", 2)],
)
def test_word_count(spark, text, words):
    assert words == len(re.findall(r"\b[\w'-]+\b", text))
    assert one(spark, text, T.word_count("t")) == words


def test_paragraphs(spark):
    text = " a \n b\t c\n \n\n\n  \n d \n\n"
    assert one(spark, text, T.paragraph_blocks("t")) == ["a b c", "d"]


@pytest.mark.parametrize(
    "url, host, blocked",
    [
        ("https://user@www.X.com:80/a?b", "user@www.X.com:80", "x.com"),
        ("ftp://x.com", None, "x.com"),
        ("www.e.org/x", None, "e.org"),
        ("", None, None),
    ],
)
def test_hosts(spark, url, host, blocked):
    assert one(spark, url, T.hostname("t")) == host
    assert one(spark, url, T.blocking_host("t")) == blocked


@pytest.mark.parametrize(
    "target, out",
    [
        ("https://www.a.com/", "a.com"),
        ("https://www.a.com/p", "https://www.a.com/p"),
        ("//www.a.com", "a.com"),
        ("http://b.org", "b.org"),
    ],
)
def test_backlink_target(spark, target, out):
    assert one(spark, target, T.backlink_target("t")) == out


def test_stable_id(spark):
    import hashlib

    frame = spark.createDataFrame([("a", None, 3)], "a string, b string, c int")
    want = hashlib.sha256(b"a|None|3").hexdigest()[:32]
    assert frame.select(T.stable_id("a", "b", "c")).first()[0] == want


def test_overlap_score(spark):
    rows = [("technical seo", "about Technical SEO", 0.98), ("red shoes", "the index page", 0.74), ("red shoes", "red car", 0.51), ("x y", "none", 0.12), ("é", "z", 0.12)]
    frame = spark.createDataFrame(rows, "k string, t string, want double")
    assert all(r["got"] == pytest.approx(r["want"]) for r in frame.withColumn("got", T.overlap_score("k", "t")).collect())


def test_cosine_of_empty_vector(spark):
    frame = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in frame.select(VX.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.707107]


def test_registered_domain(spark):
    frame = spark.createDataFrame([("a.b.example.co.uk",), ("co.uk",), ("x.com",), ("nothing",)], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    got = {r["host"]: r["registered_domain"] for r in T.registered_domain(frame, "host", suffixes).collect()}
    assert got == {"a.b.example.co.uk": "example.co.uk", "co.uk": None, "x.com": "x.com", "nothing": None}
