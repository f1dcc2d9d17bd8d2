"""Text and URL functions as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track clicks; any name that starts
# with ``utm_`` is dropped as well.
CLICK_ID_PARAMS = ("srsltid", "gclid", "dclid", "msclkid", "fbclid", "gbraid", "wbraid")

def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at both ends (line breaks, tabs and no-break blanks too)."""
    return F.regexp_replace(_c(text), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def normalize_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"(?U)[\s\x1C-\x1F]+", " "))


def paragraph_blocks(text: Column | str) -> Column:
    """Blocks between blank lines, each with its whitespace collapsed."""
    blocks = F.split(_c(text), r"(?U)\n[\s\x1C-\x1F]*\n+")
    # Line trimming plus joining lines by a blank equals collapsing whitespace.
    cleaned = F.transform(blocks, normalize_whitespace)
    return F.filter(cleaned, lambda block: block != "")


def word_count(text: Column | str) -> Column:
    r"""Words in the sense of ``\b[\w'-]+\b``: runs that hold a word character.

    Counting from the first word character keeps the match linear; a run of
    quotes and hyphens alone is no word.
    """
    return F.regexp_count(_c(text), F.lit(r"[_\p{L}\p{N}][_'\p{L}\p{N}-]*")).cast("bigint")


def hostname(url: Column | str) -> Column:
    """Authority of an http(s) URL with port and user info; null if none."""
    return F.nullif(F.regexp_extract(_c(url), r"^https?://([^/]+)", 1), F.lit(""))


def blocking_host(url: Column | str) -> Column:
    """Lower-case host without scheme, user info, port and ``www.``."""
    host = F.lower(stripped(url))
    host = F.regexp_replace(host, r"^.*?://", "")
    host = F.regexp_extract(host, r"^([^/?#]*)", 1)
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.regexp_extract(host, r"^([^:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def host_suffixes(host: Column | str) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]; the keys an entry of a blocklist can match."""
    parts = F.split(_c(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


# Parts that form encoding leaves as they are.
_PLAIN = r"\A[A-Za-z0-9._-]*\z"


def _decoded(text: Column) -> Column:
    # A lone % is literal text in form decoding; escape it so that decoding holds.
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _reencode(text: Column) -> Column:
    """Decode a query part and encode it again as form data does."""
    # Java's encoder keeps "*" and escapes "~"; form encoding does the opposite.
    encoded = F.url_encode(_decoded(text))
    changed = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(F.rlike(text, F.lit(_PLAIN)), text).otherwise(changed)


def canonical_url(url: Column | str) -> Column:
    """URL identity: no fragment, no click-tracking parameters, form-encoded query."""
    base = F.regexp_extract(_c(url), r"^([^#]*)", 1)
    path = F.regexp_extract(base, r"^([^?]*)", 1)
    query = F.regexp_extract(base, r"^[^?]*\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda pair: pair != "")

    def key_of(pair):
        return F.substring_index(pair, "=", 1)

    def value_of(pair):
        return F.regexp_extract(pair, r"^[^=]*=(.*)$", 1)

    def tracked(pair):
        def named(key):
            return key.isin(*CLICK_ID_PARAMS) | key.startswith("utm_")

        key = key_of(pair)
        return F.when(F.rlike(key, F.lit(_PLAIN)), named(F.lower(key))).otherwise(named(F.lower(_decoded(key))))

    kept = F.filter(pairs, lambda pair: ~tracked(pair))
    sign = lambda i: F.when(i == 0, F.lit("?")).otherwise(F.lit("&"))
    asked = F.transform(kept, lambda p, i: F.concat(sign(i), _reencode(key_of(p)), F.lit("="), _reencode(value_of(p))))
    scheme = F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1))
    rebuilt = F.concat(scheme, F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""))
    # Most URLs have no query; its parts are looked at only where there is one.
    return F.when(F.contains(base, F.lit("?")), F.concat(rebuilt, F.array_join(asked, ""))).otherwise(rebuilt)


def stable_id(*parts: Column | str) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by a bar."""
    texts = [F.coalesce(_c(part).cast("string"), F.lit("None")) for part in parts]
    return F.left(F.sha2(F.concat_ws("|", *texts), 256), F.lit(32))


def fold_case(text: Column | str) -> Column:
    return F.lower(_c(text))


def backlink_target(target: Column | str) -> Column:
    """Page URLs pass; bare hosts lose scheme and a leading ``www.``."""
    t = _c(target)
    rest = F.regexp_replace(t, r"^.*?://", "")
    path = F.regexp_extract(rest, r"^[^/]*(/.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(t, r"^/+", ""), r"^www\.", "")
    return (
        F.when(~F.contains(t, F.lit("://")), bare)
        .when(path.isin("", "/"), F.regexp_replace(host, r"^www\.", ""))
        .otherwise(t)
    )


def slug(text: Column | str) -> Column:
    out = F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(out, r"^-+|-+$", "")


def query_prompt(query: Column | str) -> Column:
    return F.concat(F.lit("task: search result | query: "), _c(query))


def document_prompt(text: Column | str, title: Column | None = None) -> Column:
    shown = F.lit("none") if title is None else F.coalesce(F.nullif(title, F.lit("")), F.lit("none"))
    return F.concat(F.lit("title: "), shown, F.lit(" | text: "), _c(text))


def registered_domain(frame: DataFrame, host: str, suffixes: DataFrame, out: str = "registered_domain") -> DataFrame:
    """Longest public suffix plus one label.

    ``suffixes(suffix string)`` is a table the caller supplies.  The suffixes of
    each distinct host are equi-joined with it, so its size does not matter.
    """
    hosts = frame.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    labels = F.split(F.col("_host"), r"\.")
    candidates = hosts.select(
        "_host", F.posexplode(host_suffixes(F.col("_host"))).alias("_pos", "suffix"), labels.alias("_labels")
    )
    matched = candidates.join(suffixes.select("suffix").distinct(), "suffix", "left_semi")
    longest = matched.groupBy("_host").agg(F.min("_pos").alias("_pos"))
    named = longest.select(
        "_host",
        F.when(
            F.col("_pos") > 0,
            F.array_join(F.expr("slice(split(_host, '[.]'), _pos, size(split(_host, '[.]')))"), "."),
        ).alias(out),
    )
    return frame.join(named, F.col(host) == F.col("_host"), "left").drop("_host")


def overlap_score(
    keyword: Column | str,
    text: Column | str,
    markers: tuple[str, ...] = ("index", "canonical"),
) -> Column:
    """Lexical relevance of a text to a keyword.

    Fixed values: 0.98 if the keyword occurs, 0.74 on a marker word, otherwise
    0.12 + 0.78 * share of keyword tokens found, at most 0.97.
    """
    k, t = fold_case(keyword), fold_case(text)
    token = F.lit(r"[a-z0-9]+")
    wanted = F.array_distinct(F.regexp_extract_all(k, token, F.lit(0)))
    shared = F.size(F.array_intersect(wanted, F.regexp_extract_all(t, token, F.lit(0))))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(t, F.lit(marker))
    ratio = shared.cast("double") / F.nullif(F.size(wanted), F.lit(0))
    return (
        F.when(F.contains(t, k), F.lit(0.98))
        .when(marked, F.lit(0.74))
        .when(F.size(wanted) == 0, F.lit(0.12))
        .when(shared == 0, F.lit(0.12))
        .otherwise(F.round(F.least(F.lit(0.12) + F.lit(0.78) * ratio, F.lit(0.97)), 6))
    )


def semantic_prompt(text: Column | str) -> Column:
    return F.concat(F.lit("task: sentence similarity | query: "), _c(text))
