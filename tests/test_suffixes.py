"""Public suffix rules: every kind of rule, hosts without an answer, rules from a stored list."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import suffixes

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp", "!alone"]


@pytest.fixture(scope="module")
def rules(spark):
    return suffixes.parsed_rules(spark.createDataFrame([(r,) for r in RULES], "value string"))


@pytest.mark.parametrize(
    ("host", "suffix", "domain"),
    [
        ("a.b.example.co.uk", "co.uk", "example.co.uk"),
        ("co.uk", "co.uk", None),
        ("other.uk", "uk", "other.uk"),
        ("X.Example.COM.", "com", "example.com"),
        ("ck", "ck", None),
        ("b.ck", "b.ck", None),
        ("a.b.ck", "b.ck", "a.b.ck"),
        ("z.a.b.ck", "b.ck", "a.b.ck"),
        ("www.ck", "ck", "www.ck"),
        ("m.www.ck", "ck", "www.ck"),
        ("kobe.jp", "jp", "kobe.jp"),
        ("c.kobe.jp", "c.kobe.jp", None),
        ("x.city.kobe.jp", "kobe.jp", "city.kobe.jp"),
        ("host.unlisted", "unlisted", "host.unlisted"),
        ("unlisted", "unlisted", None),
        ("alone", None, "alone"),
        ("10.0.0.1", None, None),
        ("[2001:db8::1]", None, None),
        ("a..com", None, None),
        (".com", None, None),
        ("", None, None),
        (None, None, None),
        ("label." * 120 + "com", "com", "label.com"),
    ],
)
def test_hosts(spark, rules, host, suffix, domain):
    got = suffixes.attach_registered_domain(spark.createDataFrame([(1, host)], "id int, host string"), "host", rules).collect()
    assert [tuple(r) for r in got] == [(1, host, suffix, domain)]


def test_stored_list(spark, tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text("// a comment\n\ncom\ncom  text after the rule\n  co.uk\n*.CK\n!www.ck\n.org\n")
    got = {(r["pattern"], r["exception"]) for r in suffixes.read_rules(spark, str(path)).collect()}
    assert got == {("com", False), ("uk.co", False), ("ck.*", False), ("ck.www", True), ("org", False)}


def test_rows_stay_and_clashing_names(spark, rules):
    """Repeated rows and one host with most rows stay; columns named like helpers or results do no harm."""
    frame = spark.createDataFrame([(i, "a.com", "old", "p") for i in range(50)] + [(50, None, "old", "p")], "id int, host string, registered_domain string, pattern string")
    got = suffixes.attach_registered_domain(frame, "host", rules)
    assert got.columns == ["id", "host", "pattern", "public_suffix", "registered_domain"]
    assert got.count() == 51 and got.where("registered_domain = 'a.com'").count() == 50
    assert suffixes.attach_registered_domain(frame.limit(0), "host", rules).count() == 0
    bare = suffixes.attach_registered_domain(frame.where("id = 0"), "host", rules.limit(0)).first()
    assert (bare["public_suffix"], bare["registered_domain"]) == ("com", "a.com")


def test_rules_are_joined_once(spark, rules):
    frame = spark.range(10).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"))
    plan = suffixes.attach_registered_domain(frame, "host", rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and "Cross" not in plan
