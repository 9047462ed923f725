"""The ``opN_*`` queries: each applies an operator, with production
parameters, to its whole table. ``QUERIES`` and ``ORACLE`` have the form of the
main registry's."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, bpe, decontam, exact_dedup, html_extract, langid, minhash, packing, quality,
               token_store, toxicity, treap, url_filter)
from .base import bounded_batches, label_fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query("op2_exact_dedup", """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
      FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t
            FROM documents))""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


# The fixed rules of the op4 query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op4_url_filter", f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
                  THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT row_number() OVER () AS k, page_id,
             translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
m AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
             arg_max(rverdict, length(rhost || rpath)) AS verdict
      FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM q LEFT JOIN m USING (k)""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} AS r(host, path, verdict)")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


@query("op5_langid")
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = label_fold(3, 1)
    net = langid.fit(docs.select("doc_id", "text", "lang").where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), net).select(
        "doc_id", "held_out", "lang_pred", "score")


def _scored(spark: SparkSession, sf_dir: str, op, label: str, fold, least: float) -> DataFrame:
    """Fit on the labels outside ``fold``, score all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~fold)
    model = op.fit(docs, labels, label)
    return op.score(docs, model).select(
        "doc_id", fold.alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", label_fold(4, 2), 0.7)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", label_fold(5, 0), 0.5)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op7_token_store")
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_minhash")
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@query("op11_align")
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.col("groups")
    rows = align.align(table(spark, sf_dir, "documents"),
                       carry=F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return rows.withColumnRenamed("groups", "groups_sha256")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" \
    + string.ascii_lowercase + "'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op13_treap", f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
q AS (SELECT row_number() OVER () AS no, item_id, {_TERMS} AS terms FROM benchmark),
qt AS (SELECT no, term, count(*) AS c FROM (SELECT no, unnest(terms) AS term FROM q) GROUP BY ALL),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, s GROUP BY term),
r AS (SELECT no, k, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN p USING (term)
      JOIN (SELECT k, 75 + (25 * len(terms) * n) // l AS m FROM d, s) USING (k)
      GROUP BY no, k)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT no, doc_id, score,
             row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id) AS rank
      FROM r JOIN d USING (k) WHERE score > 0) JOIN q USING (no) WHERE rank <= 20""")
def op13_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
