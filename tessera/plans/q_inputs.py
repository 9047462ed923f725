"""Bindings whose inputs the driver tables hold only in part; the rest (page
times, site prefixes, bucket attributes, session payloads, attachments, a second
listing) is derived from row numbers, so that every branch occurs and the work
grows with the tables. The oracles state the expected values from the same
numbers, not by the operators' steps."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.answers import answer_context
from ..operators.catalog import (DEFAULT_UPLOAD_FOLDER, NO_ATTACHMENT, bucket_details, object_rows,
                                 stage_attachments)
from ..operators.chunking import corpus_chunks
from ..operators.retrieval import CONTEXT_SEPARATOR, DEFAULT_K, retrieve
from ..operators.sessions import MEMORY_PREFIX, ingest_memory, memory_rows
from ..operators.web import DEFAULT_TOP_PAGES, NO_URLS, PAGE_SEPARATOR, web_search
from ..functions.html import MAX_PAGE_CHARS
from ..functions.sql import register_sql_functions, register_table_functions
from ..sources.manifest import changes
from ..sources.sessions import normalize_sessions
from ..sources.tables import read_table, read_text_table
from . import sqlparts as S
from .q_catalog import _MANIFEST_SQL, manifest
from .q_ingest import _RETRIEVE_SQL
from .q_memory import APP
from .q_web import FALLBACK_MIN_SCORE, SEARCH_RESULTS, _PT, _search_sql, _URLS_SQL
from .registry import query

DAY = dt.datetime(2024, 1, 1)


def _queries(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- answers ------------------------------------------------------------------

@query("answer_context", sql=_RETRIEVE_SQL + f""", {_search_sql(SEARCH_RESULTS)}, {_URLS_SQL},
good AS (SELECT DISTINCT query_id FROM hits WHERE score >= {FALLBACK_MIN_SCORE!r}),
blocks AS (
  SELECT u.query_id, u.pos, u.url, {S.page_output('u.url', 'p.text', MAX_PAGE_CHARS)} AS block
  FROM urls u LEFT JOIN (SELECT url, {S.page_text('html')} AS text
                         FROM (SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url)) p USING (url)
),
bagg AS (SELECT query_id, string_agg(url, chr(10) ORDER BY pos) AS urls,
                chr(10) || chr(10) || string_agg(block, {S.sql_str(PAGE_SEPARATOR)} ORDER BY pos) AS bundle
         FROM blocks GROUP BY query_id)
SELECT query_id, 'internal' AS tier, string_agg(text, {S.sql_str(CONTEXT_SEPARATOR)} ORDER BY rank) AS context,
       string_agg(source || '#' || CAST(chunk_index AS VARCHAR), chr(10) ORDER BY rank) AS sources
FROM hits JOIN good USING (query_id) GROUP BY query_id
UNION ALL
SELECT b.item_id, 'web', coalesce(a.bundle, {S.sql_str(NO_URLS)}), coalesce(a.urls, '')
FROM benchmark b LEFT JOIN bagg a ON a.query_id = b.item_id WHERE b.item_id NOT IN (SELECT query_id FROM good)""")
def q_answer_context(spark, sf_dir):
    """The joined context and its sources per query, from the chunks or,
    for queries without a good chunk, from the pages found."""
    docs = read_text_table(spark, sf_dir, "documents")
    return answer_context(_queries(spark, sf_dir), corpus_chunks(docs), read_text_table(spark, sf_dir, "pages"),
                          FALLBACK_MIN_SCORE, results=SEARCH_RESULTS,
                          chunks_of=lambda sources: corpus_chunks(docs, sources=sources))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_embedder():
    """A small embedding model as a pandas UDF: letter counts at unit length."""
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.array([t.count(c) for c in _LETTERS], float)
            n = np.sqrt((v * v).sum())
            return (v / n if n else v).tolist()
        return texts.fillna("").map(one)
    return embed


def _vector_sql(src: str, key: str) -> str:
    counts = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in _LETTERS)
    return (f"SELECT {key} AS id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END) AS v FROM ("
            f"SELECT {key}, v, sqrt(list_dot_product(v, v)) AS n FROM ("
            f"SELECT {key}, CAST([{counts}] AS DOUBLE[]) AS v FROM {src}))")


@query("retrieve_embedded", sql=f"""
WITH {S.chunk_ctes()},
qv AS ({_vector_sql('benchmark', 'item_id')}), cv AS ({_vector_sql('chunks', 'chunk_id')}),
p AS (SELECT qv.id AS query_id, cv.id AS chunk_id, round(list_dot_product(qv.v, cv.v), 6) AS score FROM qv, cv)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank,
       chunk_id, source, chunk_index, score
FROM p JOIN chunks USING (chunk_id) QUALIFY rank <= {DEFAULT_K}""")
def q_retrieve_embedded(spark, sf_dir):
    """H1: retrieval with an embedding model plugged in (exact, dense)."""
    hits = retrieve(_queries(spark, sf_dir), corpus_chunks(read_text_table(spark, sf_dir, "documents")),
                    DEFAULT_K, embedder=letter_embedder())
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "source",
                       "chunk_index", "score")


# --- search with per-query sites and page times ------------------------------------

_SITE = "example.org"


@query("web_search_dated", sql=f"""
WITH {_PT},
_ptf AS (SELECT *, {S.host('url')} AS h FROM _pt WHERE page_id % 60 >= 30),
{S.bm25_ctes('benchmark', 'item_id', 'text', '_ptf', 'page_id', 'text', 1000000)},
_in AS (SELECT t.query_id, t.doc_id AS page_id, t.score FROM bm_top t JOIN _ptf p ON p.page_id = t.doc_id
        WHERE t.query_id % 3 <> 0 OR h = '{_SITE}' OR ends_with(h, '.{_SITE}'))
SELECT query_id, page_id, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS rank
FROM _in QUALIFY rank <= 5""")
def q_web_search_dated(spark, sf_dir):
    """Pages of the last 30 days, every third query with its own
    ``site:`` prefix."""
    pages = read_text_table(spark, sf_dir, "pages").withColumn(
        "fetched_at", F.lit(DAY) + F.make_dt_interval((F.col("page_id") % 60).cast("int")))
    q = _queries(spark, sf_dir).withColumn("text", F.when(
        F.col("query_id") % 3 == 0, F.concat(F.lit(f"site:{_SITE} "), "text")).otherwise(F.col("text")))
    items, _ = web_search(q, pages, 5, recent_days=30, as_of=F.lit(DAY + dt.timedelta(days=60)))
    return items.select("query_id", "page_id", "score", F.col("rank").cast("int").alias("rank"))


# --- memory ---------------------------------------------------------------------

_KEEP = 3
_ID = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"


@query("memory_ingest", sql=f"""
WITH _e AS (SELECT *, CAST(conv_id % 20 AS VARCHAR) AS u FROM conversations),
_last AS (SELECT u, conv_id, max(conv_id * 7 % 1000 * 1440 + turn) AS t FROM _e GROUP BY ALL),
_top AS (SELECT u, conv_id FROM _last
         QUALIFY row_number() OVER (PARTITION BY u ORDER BY t DESC, CAST(conv_id AS VARCHAR)) <= {_KEEP}),
_new AS (SELECT u, conv_id, turn, text, 'new' AS state FROM _e JOIN _top USING (u, conv_id)),
_old AS (SELECT u, conv_id, turn, text || ' (old)' AS text, 'old' AS state FROM _e
         WHERE conv_id % 2 = 0 AND (u, conv_id) NOT IN (SELECT (u, conv_id) FROM _top))
SELECT '{APP}' AS app_name, u AS user_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS seq,
       {S.uuid5(_ID, MEMORY_PREFIX + APP)} AS memory_id, replace(text, 'John Doe', '[PERSON_NAME]') AS text,
       CASE WHEN state = 'new' THEN count(*) FILTER (WHERE state = 'new') OVER (PARTITION BY conv_id) END AS generated
FROM (SELECT n.*, c.role FROM (FROM _new UNION ALL FROM _old) n JOIN conversations c USING (conv_id, turn))
WHERE role = 'user' AND coalesce(text, '') <> ''""")
def q_memory_ingest(spark, sf_dir):
    """C8 end to end: each user's 3 most recent sessions (T3, J4) become
    memories that replace those of an earlier ingest (J2), counted per session
    (A12)."""
    c = read_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 20).cast("string").alias("user_id"), F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("seq"), "role", "text",
        (F.lit(DAY) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("conv_id") * 7 % 1000 * 1440 + F.col("turn"))
                                         .cast("int"))).alias("ts"))
    old = memory_rows(c.where((F.col("role") == "user") & (F.col("session_id").cast("long") % 2 == 0))
                      .withColumn("text", F.concat("text", F.lit(" (old)"))), APP)
    table, counts = ingest_memory(c, APP, _KEEP, existing=old)
    counts = counts.select("session_id", F.col("generated_memories").alias("generated"))
    return table.join(counts, "session_id", "left").select(
        "app_name", "user_id", "session_id", "seq", "memory_id", "text", "generated")


@query("session_records", sql="""
WITH _s AS (SELECT event_id, event_id % 3 AS shape, event_id % 4 AS k, event_id % 6 AS key, event_id % 5 AS ids,
                   ts, epoch_us(ts) / 1000000 AS sec FROM events)
SELECT event_id, CASE WHEN ids IN (0, 2) THEN 's' || event_id ELSE 'i' || event_id END AS session_id,
       CASE k WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) WHEN 1 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE)
              WHEN 2 THEN CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS DOUBLE) ELSE 0 END AS updated_epoch
FROM _s WHERE shape < 2 AND ids <> 4""")
def q_session_records(spark, sf_dir):
    """S10 and the T3 time keys: session payloads as wrapped and bare lists and
    null, ids under either key or missing, times as number, ISO text, basic
    date or absent, under each known key."""
    from ..operators.sessions import SESSION_TIME_KEYS
    e = read_table(spark, sf_dir, "events")
    n, sec = F.col("event_id"), F.floor(F.unix_micros("ts") / 1000000).cast("long")
    key = F.element_at(F.lit(list(SESSION_TIME_KEYS)), (n % 6 + 1).cast("int"))
    at = (F.when(n % 4 == 0, sec.cast("string"))
          .when(n % 4 == 1, F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
          .when(n % 4 == 2, F.concat(F.lit('"'), F.date_format("ts", "yyyyMMdd"), F.lit('"'))))
    time = F.when(at.isNotNull(), F.concat(F.lit(', "'), key, F.lit('": '), at)).otherwise(F.lit(""))
    sid, iid = F.concat(F.lit("s"), n.cast("string")), F.concat(F.lit("i"), n.cast("string"))

    def pair(k, v):
        return F.concat(F.lit(f'"{k}": "'), v, F.lit('"'))
    ids = (F.when(n % 5 == 0, pair("session_id", sid)).when(n % 5 == 1, pair("id", iid))
           .when(n % 5 == 2, F.concat(pair("id", iid), F.lit(", "), pair("session_id", sid)))
           .when(n % 5 == 3, F.concat(F.lit('"session_id": "", '), pair("id", iid)))
           .otherwise(F.lit('"title": "none"')))
    one = F.concat(F.lit("{"), ids, time, F.lit("}"))
    payload = (F.when(n % 3 == 0, F.concat(F.lit('{"sessions": ['), one, F.lit("]}")))
               .when(n % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.lit("null")))
    return normalize_sessions(e.select("event_id", payload.alias("payload")), keep=("event_id",)) \
        .select("event_id", "session_id", "updated_epoch")


# --- catalog ----------------------------------------------------------------------

@query("object_times", sql="""
SELECT event_type AS bucket, 'e/' || event_id AS name, event_id AS size, 'application/json' AS content_type,
       CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS updated
FROM events""")
def q_object_times(spark, sf_dir):
    """X11: update times of objects in ISO form, null where unknown."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bucket"), F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("name"),
        F.col("event_id").alias("size"), F.lit("application/json").alias("content_type"),
        F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("updated"))
    return object_rows(e).select("bucket", "name", "size", "content_type", "updated")


_BUCKET = "corpus-de"


@query("bucket_attributes", sql=f"""
WITH {_MANIFEST_SQL}
SELECT 'bucket' AS kind, '{_BUCKET}' AS name, 'id-{_BUCKET}' AS id, 'EU' AS location, 'STANDARD' AS storage_class,
       true AS versioning_enabled, 'lang=de' AS labels, md5('{_BUCKET}') AS etag,
       '2024-01-01T00:00:00.000000+00:00' AS created,
       'https://storage.googleapis.com/{_BUCKET}' AS self_link, count(*)::BIGINT AS file_count,
       'Successfully retrieved details and ' || count(*) || ' file(s) for bucket ''{_BUCKET}''' AS message
FROM manifest WHERE bucket = '{_BUCKET}'
UNION ALL
SELECT 'file', name, 'gs://' || bucket || '/' || name, NULL, content_type, NULL, NULL, NULL, NULL,
       'https://storage.googleapis.com/' || bucket || '/' || name, size, NULL
FROM manifest WHERE bucket = '{_BUCKET}'""")
def q_bucket_attributes(spark, sf_dir):
    """A2/C6 for one bucket: its attributes, file count and message, and its
    files as rows."""
    m = manifest(spark, sf_dir)
    name = F.col("name")
    b = m.groupBy(F.col("bucket").alias("name")).agg(F.lit(DAY).alias("created")).select(
        "name", F.concat(F.lit("id-"), name).alias("id"), F.lit("EU").alias("location"),
        F.lit("STANDARD").alias("storage_class"), F.lit(True).alias("versioning_enabled"),
        F.create_map(F.lit("lang"), F.right(name, F.lit(2))).alias("labels"), F.md5(name).alias("etag"), "created")
    row, files = bucket_details(b, m, _BUCKET)
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    row = row.withColumn("labels", labels).withColumn("kind", F.lit("bucket"))
    files = files.select(F.lit("file").alias("kind"), "name", F.col("gcs_uri").alias("id"),
                         F.col("content_type").alias("storage_class"), F.col("public_url").alias("self_link"),
                         F.col("size").alias("file_count"))
    cols = ["kind", "name", "id", "location", "storage_class", "versioning_enabled", "labels", "etag", "created",
            "self_link", "file_count", "message"]
    return row.select(cols).unionByName(files, allowMissingColumns=True).select(cols)


@query("staged_attachments", sql=f"""
WITH _m AS (SELECT conv_id, turn, conv_id + turn AS x, coalesce(text, '') AS t FROM conversations),
_f AS (SELECT *, x % 4 IN (1, 2) AND t <> '' AS has,
              CASE WHEN x % 3 = 0 THEN 'inbox/' || conv_id || '.bin'
                   ELSE '{DEFAULT_UPLOAD_FOLDER}' || 'file' || turn ||
                        CASE WHEN x % 5 = 0 THEN '.PDF' WHEN x % 7 = 0 THEN '' ELSE '.pdf' END END AS dest FROM _m)
SELECT conv_id || ':' || turn AS message_id, CASE WHEN has THEN 'success' ELSE 'error' END AS status,
       CASE WHEN has THEN dest END AS filename, CASE WHEN has THEN 'gs://up/' || dest END AS gcs_uri,
       CASE WHEN has THEN strlen(t)::INTEGER END AS size_bytes,
       CASE WHEN has THEN CASE WHEN x % 7 = 0 THEN 'application/zip' ELSE 'application/pdf' END END AS content_type,
       CASE WHEN has THEN 'Successfully uploaded file to gs://up/' || dest ELSE {S.sql_str(NO_ATTACHMENT)} END AS message
FROM _f""")
def q_staged_attachments(spark, sf_dir):
    """Messages whose first application part has bytes, has none (later
    parts are not tried), or that have only text and image parts."""
    c = read_table(spark, sf_dir, "conversations")
    x, data = F.col("conv_id") + F.col("turn"), F.coalesce("text", F.lit("")).cast("binary")

    def part(mime, d):
        return F.struct(F.lit(mime).alias("mime_type"), d.alias("data"))
    image, app = part("image/png", F.lit(b"img")), part("application/octet-stream", data)
    empty = part("application/pdf", F.lit(b""))
    parts = (F.when(x % 4 == 0, F.array(image)).when(x % 4 == 1, F.array(image, app))
             .when(x % 4 == 2, F.array(app, empty)).otherwise(F.array(empty, app)))
    m = c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("message_id"),
        parts.alias("parts"), F.when(x % 7 == 0, "application/zip").alias("content_type"),
        F.concat(F.lit("file"), F.col("turn").cast("string"), F.when(x % 5 == 0, ".PDF").otherwise("")).alias("artifact_name"),
        F.when(x % 3 == 0, F.concat(F.lit("inbox/"), F.col("conv_id").cast("string"), F.lit(".bin")))
        .when(x % 3 == 1, "").alias("destination"))
    return stage_attachments(m, "up").select("message_id", "status", "filename", "gcs_uri", "size_bytes",
                                             "content_type", "message")


@query("manifest_changes", sql="""
SELECT source || '/' || doc_id || '.txt' AS uri,
       CASE WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'deleted'
            WHEN doc_id % 10 = 3 THEN 'changed' WHEN doc_id % 10 = 4 THEN 'same' ELSE 'same' END AS status,
       CAST(CASE WHEN doc_id % 10 = 3 THEN strlen(text) + 1 ELSE strlen(text) END AS BIGINT) AS length
FROM documents""")
def q_manifest_changes(spark, sf_dir):
    """A listing of the corpus against the manifest of the time before:
    objects new, deleted, changed, touched (a new time, the same bytes) or as
    they were."""
    d = read_table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 10
    base = d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("uri"),
                    F.octet_length("text").cast("long").alias("length"), F.lit(DAY).alias("modified"),
                    F.sha2("text", 256).alias("digest"))
    old = base.where(n != 1).drop("doc_id")
    moved = n.isin(3, 4)
    now = base.where(n != 2).select(
        "uri", F.when(n == 3, F.col("length") + 1).otherwise(F.col("length")).alias("length"),
        F.when(moved, F.col("modified") + F.make_dt_interval(F.lit(1))).otherwise(F.col("modified")).alias("modified"),
        F.when(n == 3, F.sha2(F.col("digest"), 256)).otherwise(F.col("digest")).alias("digest"))
    return changes(old, now).select("uri", "status", "length")


@query("sql_functions", sql=f"""
WITH {S.chunk_ctes()}
SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, min(chunk_id) AS first_id
FROM chunks GROUP BY source""")
def q_sql_functions(spark, sf_dir):
    """H4: chunking and ids through the SQL functions alone."""
    from ..functions.ids import namespace_hex
    from ..operators.chunking import CORPUS_PREFIX
    register_sql_functions(spark)
    read_text_table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql(f"""
        SELECT source, count(*) AS chunks, sum(length(chunk)) AS chars,
               min(tessera_uuid5('{namespace_hex(CORPUS_PREFIX)}', concat(source, '::chunk::', i))) AS first_id
        FROM (SELECT source, posexplode(parts) AS (i, chunk)
              FROM (SELECT concat('{CORPUS_PREFIX}', source, '/', doc_id, '.txt') AS source,
                           tessera_chunks(text, 1000, 100) AS parts FROM tessera_documents))
        GROUP BY source""")


@query("chunk_table_function", sql=f"""
WITH {S.chunk_ctes()}
SELECT chunk_id, source, chunk_index, text FROM chunks""")
def q_chunk_table_function(spark, sf_dir):
    """X2-X5 for SQL callers: chunks by a table function over a TABLE argument."""
    from ..operators.chunking import CORPUS_PREFIX
    register_table_functions(spark)
    read_text_table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql(f"""
        SELECT * FROM tessera_chunk_table(TABLE(
            SELECT concat('{CORPUS_PREFIX}', source, '/', doc_id, '.txt') AS uri, text FROM tessera_documents),
            '{CORPUS_PREFIX}', 1000, 100)""")
