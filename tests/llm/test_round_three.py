"""Source divergence, license scans and centroid clustering against SQL and brute force on odd small tables."""

import hashlib
import math
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import centroid_clustering, divergence, licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MIT = licenses.TEMPLATES[13].text


def sql_rows(sql, names, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    cursor = con.execute(sql)
    found = [c[0] for c in cursor.description]
    return sorted(([str(r[found.index(n)]) for n in names] for r in cursor.fetchall()), key=str)


def spark_rows(frame, names):
    return sorted(([str(r[n]) for n in names] for r in frame.select(*names).collect()), key=str)


def doc_table(rows):
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])})


def made_documents():
    """Three languages, one of 150 sources (three blocks), copies within and across sources, odd rows."""
    rng = random.Random(11)
    out = []
    for i in range(700):
        words = [f"w{chr(97 + min(int(rng.expovariate(0.2)), 25))}" for _ in range(rng.randint(0, 30))]
        out.append((i, " ".join(words), "en", f"h{rng.randrange(150) if i % 3 else 0}", 1))
    copy = "Shared TEXT of many, many sources; Ünïcode ŠÀ 日本語 don't x1y2"
    out += [(1000 + i, copy, "en", f"h{i % 40}", 1) for i in range(300)]
    out += [(2000 + i, "alpha beta alpha gamma", "de", f"s{i % 3}", 1) for i in range(30)]
    out += [(3000, "alone", "xx", "one", 1), (3001, "too few", "yy", "one", 1), (3002, None, "yy", "two", 1)]
    out += [(3003, None, None, None, None), (3004, "", "en", None, 0), (None, "1234 56 !!", None, "src", 1), (3005, "wa wb " * 20000, "en", "long", 1)]
    out += [(3005, "wa wb " * 20000, "en", "long", 1), (3006, copy, None, None, 1)]
    return out


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_equals_sql(spark):
    rows = made_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({"term": F.lit(1), "p": F.lit("x"), "places": F.lit(None), "value": F.lit(2)})
    assert spark_rows(divergence.audited(docs), AUDIT) == sql_rows(divergence.SQL, AUDIT, documents=doc_table(rows))


def test_divergence_by_hand(spark):
    rows = [(i, "a", "en", "x", 1) for i in range(10)] + [(20 + i, "A b", "en", "y", 1) for i in range(10)] + [(40, None, "en", None, 1)]
    got = {(r.source, r.part, r["item"]): (r.value, r["rank"]) for r in divergence.audited(spark.createDataFrame(rows, SCHEMA)).collect()}
    p = lambda n, total: 1 + 10**9 * (n + 2) // (total + 4)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    x, y, none, whole = [p(10, 10), p(0, 10)], [p(10, 20), p(10, 20)], [p(0, 0), p(0, 0)], [p(20, 30), p(10, 30)]
    assert got["x", "pair", "y"][0] == got["y", "pair", "x"][0] == sum(map(f, x, y))
    assert got["x", "pair", ""][0] == sum(map(f, x, none))
    assert got["x", "term", "a"] == (f(x[0], whole[0]), 1) and ("x", "term", "b") not in got
    assert got["y", "term", "b"] == (f(y[1], whole[1]), 1)


def test_divergence_of_nothing(spark):
    assert divergence.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def license_documents():
    words = MIT.split()
    edited = [w for i, w in enumerate(words) if i % 17 != 5]
    inserted = words[:20] + ["oddly"] * 3 + words[20:]
    return [
        (1, MIT, "en", "a", 1),
        (2, "before it " + " ".join(edited) + " after", "en", "a", 1),
        (3, " ".join(inserted).upper(), "en", "a", 1),
        (4, " ".join(words[:25]), "en", "a", 1),
        (5, "the MIT, License. mit_license MIT\nLICENSE gnu general public license v3; cc-by-nc; Apache License!", "en", "a", 1),
        (5, "the MIT, License. mit_license MIT\nLICENSE gnu general public license v3; cc-by-nc; Apache License!", "en", "a", 1),
        (6, "general public license", "en", "a", 1),
        (7, None, "en", "a", 1),
        (8, "", None, None, 1),
        (None, "cc by cc by cc by", "en", "a", 1),
        (10, "mit license " * 3000, "en", "a", 1),
        (11, "Ãpache license apache ÃLicense 日本語 mit license", "en", "a", 1),
        (12, "mitlicense mit licenses gpl", "en", "a", 1),
        (13, MIT + " and then " + MIT, "en", "a", 1),
    ]


SCAN = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_licenses_equal_sql(spark):
    rows = license_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"key": F.lit(1), "gram": F.lit("x"), "spans": F.lit(0), "template": F.lit(2)})
    result = licenses.digest(licenses.scanned(docs))
    expected = sql_rows(licenses.SQL, SCAN, documents=doc_table(rows))
    assert spark_rows(result, SCAN) == expected


def test_licenses_base_by_brute_force(spark):
    rows = license_documents() + [(9, "filler " * 70000 + "mit license " + "x " * 70000 + "mit license", "en", "a", 1)]
    got = sorted(([r[n] for n in SCAN[:6]] for r in licenses.digest(licenses.scanned(spark.createDataFrame(rows, SCHEMA))).collect()), key=str)
    expected = []
    for doc_id, text, *_ in rows:
        words = licenses.words_of(text or "")
        places = [(i, t.label) for t in licenses.TEMPLATES if t.base for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
        at = [i for i, _ in places]
        expected.append([doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))])
    assert got == sorted(expected, key=str)


def test_licenses_of_edited_bodies(spark):
    got = {r.doc_id: r for r in licenses.digest(licenses.scanned(spark.createDataFrame(license_documents(), SCHEMA))).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 6)] == ["mit", "mit", "mit", "", ""]
    assert got[1].score == 1.0 and 0.6 <= got[2].score < 1 and got[3].score > 0.9 and 0 < got[4].score < 0.6
    assert got[5].labels == "apache,cc-by,cc-by-nc,gpl,mit"
    assert got[7].score == got[8].score == 0.0 and got[10].n_base == 3000


def test_licenses_of_nothing(spark):
    assert licenses.digest(licenses.scanned(spark.createDataFrame([], SCHEMA))).count() == 0


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_clusters(rows, k, rounds):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(vectors, key=name)[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in vectors]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(vectors, at) if c == j]
            centroids[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else centroids[j]
    final = [(i, *nearest(v)) for i, v in vectors]
    of = lambda j: sum(d for _, d, c in final if c == j)
    total = sum(d for _, d, _ in final)
    return sorted(([str(x) for x in (i, j, d, of(j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())] for i, d, j in final), key=str)


@pytest.fixture(scope="module")
def vector_rows():
    rng = random.Random(13)
    base = [(i, [rng.choice([-1, -0.5, 0, 0.25, 0.7]) * rng.random() for _ in range(64)], 1) for i in range(120)]
    base = [(i, [float(pa.scalar(x, pa.float32()).as_py()) for x in v], n) for i, v, n in base]
    hot = base[0][1]
    odd = [(500 + i, hot, 0) for i in range(60)] + [(7, base[7][1], 1), (None, base[3][1], None), (600, None, 1), (601, [], 1), (602, [0.5] * 63, 1), (603, [0.5] * 65, 1)]
    odd += [(604, [0.5] * 63 + [None], 1), (605, [float("nan")] + [0.0] * 63, 1), (606, [float("inf")] + [0.0] * 63, 1), (607, [-0.0] * 64, 1), (608, [1000.0] * 64, 1), (609, [-1000.0] * 64, 1)]
    return base + odd


def test_centroids_equal_brute_force(spark, vector_rows):
    frame = spark.createDataFrame(vector_rows, VECTORS).repartition(5).withColumns({"v": F.lit("x"), "dots": F.lit(1), "cluster": F.lit("c"), "x": F.lit(0)})
    assert spark_rows(centroid_clustering.clustered(frame), CLUSTERED) == brute_clusters(vector_rows, 40, 5)


def test_centroids_equal_sql(spark, vector_rows):
    table = pa.table({"vec_id": pa.array([r[0] for r in vector_rows], pa.int64()), "embedding": pa.array([r[1] for r in vector_rows], pa.list_(pa.float32()))})
    frame = spark.createDataFrame(vector_rows, VECTORS)
    assert spark_rows(centroid_clustering.clustered(frame), CLUSTERED) == sql_rows(centroid_clustering.SQL, CLUSTERED, embeddings=table)


def test_centroids_few_and_none(spark, vector_rows):
    few = vector_rows[:7] + vector_rows[:2]
    assert spark_rows(centroid_clustering.clustered(spark.createDataFrame(few, VECTORS)), CLUSTERED) == brute_clusters(few, 40, 5)
    assert centroid_clustering.clustered(spark.createDataFrame([], VECTORS)).count() == 0


def test_centroids_refuse_components_beyond_exact_distances(spark):
    with pytest.raises(Exception, match="beyond"):
        centroid_clustering.clustered(spark.createDataFrame([(1, [1e9] * 64, 1)], VECTORS)).collect()
