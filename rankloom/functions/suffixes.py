"""Registered domains by public suffix rules: plain, wildcard and exception rules, in one join.

The rules are data: one rule a line as in the published list, read with :func:`read_rules`
or given as a table.  Names are matched from the right, so a rule is keyed by its labels in
reversed order; a host offers every reversed prefix of its labels, once as it is and once
with a star for the leftmost label, and one equi-join finds all rules that apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDRESS = r"^[0-9]+(\.[0-9]+){3}$|:"


def parsed_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(pattern, exception)`` of rules written one a line.

    A line counts up to its first white space.  Empty lines, comments (``//``) and null lines
    are no rules; repeated rules count once.  A leading star stands for exactly one label, a
    leading ``!`` marks an exception; a star anywhere else is an ordinary label that no host has.
    """
    rule = F.lower(F.regexp_extract(F.trim(F.col(line)), r"^(\S*)", 1))
    named = lines.select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    name = F.regexp_replace(F.regexp_replace("rule", r"^!", ""), r"^\.|\.$", "")
    return named.select(_reversed(name).alias("pattern"), F.col("rule").startswith("!").alias("exception")).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a published list stored as text."""
    return parsed_rules(spark.read.text(path))


def _reversed(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def attach_registered_domain(
    frame: DataFrame,
    host: str,
    rules: DataFrame,
    suffix: str = "public_suffix",
    out: str = "registered_domain",
) -> DataFrame:
    """Each row plus the public suffix of its host and that suffix with one more label.

    An exception rule prevails and gives itself without its leftmost label; otherwise the
    rule with the most labels counts, and where none applies the last label is the suffix.
    Hosts are compared in lower case and without a final dot.  A host that is itself a suffix
    has no registered domain.  Null, empty hosts, hosts with an empty label and addresses have
    neither.  Names are compared as written: international names need the spelling of the rules.

    Only distinct hosts meet the rules; columns of ``frame`` with the added names are replaced.
    """
    hosts = frame.select(F.col(host).alias("__host")).where("__host is not null").distinct()
    name = F.regexp_replace(F.lower("__host"), r"\.$", "")
    labels = F.split(name, r"\.")
    usable = ~F.array_contains(labels, "") & ~F.rlike(name, F.lit(ADDRESS))
    named = hosts.select("__host", F.reverse(labels).alias("__labels")).where(usable)

    # Of every length: the labels themselves, and a star in place of the last one.
    def prefixes(n: Column) -> Column:
        plain = F.array_join(F.slice("__labels", F.lit(1), n), ".")
        starred = F.array_join(F.concat(F.slice("__labels", F.lit(1), n - 1), F.array(F.lit("*"))), ".")
        return F.array(F.struct(plain.alias("pattern"), n.alias("n")), F.struct(starred.alias("pattern"), n.alias("n")))

    lengths = F.sequence(F.lit(1), F.size("__labels"))
    offered = named.select("__host", F.explode(F.flatten(F.transform(lengths, prefixes))).alias("__o")).select("__host", "__o.*")
    found = (
        offered.join(rules.select("pattern", "exception"), "pattern")
        .groupBy("__host")
        .agg(F.max(F.when(F.col("exception"), F.col("n") - 1)).alias("__exception"), F.max("n").alias("__longest"))
    )
    n = F.coalesce("__exception", "__longest", F.lit(1))

    def shown(count: Column) -> Column:
        return F.array_join(F.reverse(F.slice("__labels", F.lit(1), count)), ".")

    answers = named.join(found, "__host", "left").select(
        "__host",
        # An exception of one label leaves nothing to be a suffix.
        F.when(n > 0, shown(n)).alias("__suffix"),
        F.when(F.size("__labels") > n, shown(n + 1)).alias("__domain"),
    )
    kept = [c for c in frame.columns if c not in (suffix, out)]
    joined = frame.join(answers, F.col(host) == F.col("__host"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col("__suffix").alias(suffix), F.col("__domain").alias(out))
