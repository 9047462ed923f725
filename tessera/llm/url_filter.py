"""URL filter by host and path rules, DataFrame functions only.

Each distinct URL is expanded into (host suffix, path prefix) expressions; an
equi-join on the first 32 bits of the expression's SHA-256 finds candidate
rules, the full digest and the rule's whole path confirm them, and the longest
confirmed rule decides.

Cost: one distinct over URLs, one join of (URLs x suffixes x prefixes) with
the rules, one join back. Only suffixes with as many labels and prefixes with
as many segments as some rule has are expanded, so a very long URL costs no
more than the rules need. No join side is forced to broadcast: Spark measures
the rules; beyond its threshold the same plan is a shuffled join, where AQE
splits hot expressions and hot URLs.

Defined cases: a null URL, or one without ``://``, has empty host and path and
matches no rule; a URL matching no rule is allowed (``default``); of equally
long rules the one with the longer host wins, then block before allow, then
the smaller text; rules with a null host or verdict are ignored, a null path is
empty; repeated rules and repeated pages are judged alike, every input row
gives one output row; empty tables give empty results; other columns of
``pages`` are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8        # 32 bits of the digest in the join key


def url_parts(url):
    """(host, path) columns of a URL column by the rules above."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest) + 1),
                            "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _digest(expr):
    return F.sha2(expr.cast("binary"), 256)


def _compiled(rules: DataFrame) -> DataFrame:
    """One row per rule: the expression it is found by is its host and its
    path up to the last slash, an expression that every URL it fits has."""
    r = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict")).distinct()
    key = F.regexp_extract("r_path", "(?s)^(.*/)?", 0)
    d = _digest(F.concat("r_host", key))
    return r.select(
        "*", d.alias("r_digest"), F.substring(d, 1, PREFIX_HEX).alias("r_prefix"),
        F.size(F.split("r_host", "\\.", -1)).alias("r_labels"),
        (F.size(F.split(key, "/", -1)) - 1).alias("r_segments"))


def _expressions(urls: DataFrame, labels: int, segments: int) -> DataFrame:
    """Rows (url, path, digest) for every expression a rule could have."""
    u = urls.select("url", *(c.alias(n) for c, n in
                             zip(url_parts(F.col("url")), ("host", "path"))))
    u = u.withColumn("parts", F.split("host", "\\.", -1)) \
         .withColumn("segs", F.split("path", "/", -1))
    suffixes = F.expr(f"transform(sequence(1, least(size(parts), {labels})), "
                      "i -> array_join(slice(parts, size(parts) - i + 1, i), '.'))")
    prefixes = F.expr(f"transform(sequence(0, least(size(segs) - 1, {segments})), "
                      "j -> if(j = 0, '', concat(array_join(slice(segs, 1, j), '/'), '/')))")
    u = u.select("url", "path", F.explode(suffixes).alias("s"), prefixes.alias("p"))
    u = u.select("url", "path", "s", F.explode("p").alias("p"))
    d = _digest(F.concat("s", "p"))
    return u.select("url", "path", d.alias("digest"),
                    F.substring(d, 1, PREFIX_HEX).alias("prefix"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``rules`` (host, path, verdict) applied: id_col, host,
    path, rule (its text, null if none fits) and verdict."""
    rules = _compiled(rules)
    top = rules.agg(F.max("r_labels").alias("l"), F.max("r_segments").alias("s")).first()
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    hits = _expressions(urls, top["l"] or 1, top["s"] or 0).join(
        rules, (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest"))
        & F.startswith(F.col("path"), F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    won = hits.groupBy("url").agg(F.min(F.struct(
        -F.length(rule), -F.length("r_host"), (F.col("r_verdict") != "block"),
        rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("w"))
    won = won.select(F.col("url").alias("w_url"), "w.rule", "w.verdict")
    host, path = url_parts(F.col("url"))
    return pages.join(won, F.col("url") == F.col("w_url"), "left").select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
