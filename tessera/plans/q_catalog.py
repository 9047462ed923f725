"""Catalog bindings: ``documents`` seen as an object manifest -- bucket
``corpus-{lang}``, object ``{source}/{doc_id}.txt``, size = UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import (bucket_summary, buckets_from_objects, list_buckets,
                                 list_entries, list_objects, object_rows, split_uri)
from ..operators.chunking import corpus_uri
from ..sources.tables import read_table
from . import sqlparts as S
from .registry import query

LIST_BUCKET = "corpus-en"
LIST_PREFIX = "src1"
FLAT_BUCKET = "corpus-de"
FLAT_PREFIX = "src1/"
BUCKET_PREFIX = "corpus-e"

_MANIFEST_SQL = """
manifest AS (
  SELECT 'corpus-' || lang AS bucket, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name,
         CAST(strlen(text) AS BIGINT) AS size, 'text/plain' AS content_type,
         CAST(NULL AS TIMESTAMP) AS updated
  FROM documents
)"""


def manifest(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("corpus-"), "lang").alias("bucket"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit("text/plain").alias("content_type"),
        F.lit(None).cast("timestamp").alias("updated"))


def _uris(col):
    return (f"'gs://' || {col}.bucket || '/' || {col}.name", f"'https://storage.googleapis.com/' || {col}.bucket || '/' || {col}.name")


@query("split_uri", sql=f"""
WITH u AS (SELECT doc_id, {S.corpus_uri()} AS uri FROM documents),
r AS (SELECT doc_id, uri, substr(uri, 6) AS rest FROM u)
SELECT doc_id, uri,
       CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END AS bucket,
       CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/') + 1) ELSE '' END AS prefix
FROM r""")
def q_split_uri(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", corpus_uri(F.col("source"), F.col("doc_id")).alias("uri"))
    b, p = split_uri(F.col("uri"))
    return d.select("doc_id", "uri", b.alias("bucket"), p.alias("prefix"))


@query("object_manifest", sql=f"""
WITH {_MANIFEST_SQL}
SELECT bucket, name, size, content_type, CAST(NULL AS VARCHAR) AS updated,
       {_uris('m')[0]} AS gcs_uri, {_uris('m')[1]} AS public_url
FROM manifest m""")
def q_object_manifest(spark, sf_dir):
    return object_rows(manifest(spark, sf_dir))


@query("common_prefixes", sql=f"""
WITH {_MANIFEST_SQL}
SELECT bucket, substr(name, 1, instr(name, '/')) AS folder, CAST(count(*) AS BIGINT) AS n_objects
FROM manifest WHERE instr(name, '/') > 0 GROUP BY ALL""")
def q_common_prefixes(spark, sf_dir):
    """Folder roll-up of every bucket with delimiter '/' (U3)."""
    _, folders = list_entries(manifest(spark, sf_dir), None, None, "/")
    return folders


_LIST_SQL = f"""
{_MANIFEST_SQL},
_o AS (SELECT *, substr(name, {len(LIST_PREFIX) + 1}) AS rest FROM manifest
       WHERE bucket = '{LIST_BUCKET}' AND starts_with(name, '{LIST_PREFIX}')),
entries AS (
  SELECT 'file' AS kind, name, size, content_type, CAST(NULL AS VARCHAR) AS updated,
         {_uris('_o')[0]} AS gcs_uri, {_uris('_o')[1]} AS public_url
  FROM _o WHERE instr(rest, '/') = 0
  UNION ALL
  SELECT DISTINCT 'folder', '{LIST_PREFIX}' || substr(rest, 1, instr(rest, '/')), CAST(NULL AS BIGINT),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         'gs://{LIST_BUCKET}/{LIST_PREFIX}' || substr(rest, 1, instr(rest, '/')),
         'https://storage.googleapis.com/{LIST_BUCKET}/{LIST_PREFIX}' || substr(rest, 1, instr(rest, '/'))
  FROM _o WHERE instr(rest, '/') > 0
),
listed AS (SELECT * FROM entries ORDER BY name, kind LIMIT 100)"""


@query("list_objects", sql=f"WITH {_LIST_SQL} SELECT * FROM listed")
def q_list_objects(spark, sf_dir):
    """Listing of bucket corpus-en under prefix 'src1' with delimiter '/',
    at most 100 entries (C5, F1, U3, T4)."""
    entries, _ = list_objects(manifest(spark, sf_dir), LIST_BUCKET, LIST_PREFIX, "/", 100)
    return entries


@query("listing_summary", sql=f"""
WITH {_LIST_SQL},
c AS (SELECT CAST(count(*) FILTER (WHERE kind = 'file') AS BIGINT) AS count,
             CAST(count(*) FILTER (WHERE kind = 'folder') AS BIGINT) AS prefix_count FROM listed)
SELECT count, prefix_count,
       'Found ' || count || ' file(s) and ' || prefix_count || ' folder(s) in bucket ''{LIST_BUCKET}'' with prefix ''{LIST_PREFIX}''' AS message
FROM c""")
def q_listing_summary(spark, sf_dir):
    """Counts and message of the list_objects listing (A1)."""
    _, summary = list_objects(manifest(spark, sf_dir), LIST_BUCKET, LIST_PREFIX, "/", 100)
    return summary


@query("list_objects_flat", sql=f"""
WITH {_MANIFEST_SQL}
SELECT 'file' AS kind, name, size, content_type, CAST(NULL AS VARCHAR) AS updated,
       {_uris('m')[0]} AS gcs_uri, {_uris('m')[1]} AS public_url
FROM manifest m WHERE bucket = '{FLAT_BUCKET}' AND starts_with(name, '{FLAT_PREFIX}')
ORDER BY name LIMIT 100""")
def q_list_objects_flat(spark, sf_dir):
    """Listing without delimiter: every object under 'src1/' of corpus-de,
    name order, first 100 (F1, T4)."""
    entries, _ = list_objects(manifest(spark, sf_dir), FLAT_BUCKET, FLAT_PREFIX, None, 100)
    return entries


@query("bucket_details", sql=f"""
WITH {_MANIFEST_SQL}
SELECT bucket, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes,
       min(name) AS first_name, max(name) AS last_name, CAST(NULL AS VARCHAR) AS updated,
       'https://storage.googleapis.com/' || bucket AS self_link
FROM manifest GROUP BY bucket""")
def q_bucket_details(spark, sf_dir):
    """Per-bucket file count and bytes."""
    return bucket_summary(manifest(spark, sf_dir))


@query("list_buckets", sql=f"""
WITH {_MANIFEST_SQL}
SELECT bucket AS name, CAST(count(*) AS BIGINT) AS file_count,
       CAST(NULL AS VARCHAR) AS created, CAST(NULL AS VARCHAR) AS updated
FROM manifest WHERE starts_with(bucket, '{BUCKET_PREFIX}') GROUP BY bucket ORDER BY name LIMIT 50""")
def q_list_buckets(spark, sf_dir):
    """Buckets whose name starts with 'corpus-e', name order, at most 50 (A3)."""
    return list_buckets(buckets_from_objects(manifest(spark, sf_dir)), BUCKET_PREFIX, 50)


# Extension of each language's objects in the file manifest of list_files:
# upper- and lower-case text files, PDFs, and a type the listing skips.
FILE_EXTENSIONS = (("en", ".txt"), ("de", ".TXT"), ("fr", ".pdf"), ("es", ".md"))


@query("list_files", sql=f"""
WITH f AS (
  SELECT 'gs://corpus/' || source || '/' || CAST(doc_id AS VARCHAR) ||
         CASE lang {' '.join(f"WHEN '{l}' THEN '{e}'" for l, e in FILE_EXTENSIONS)} ELSE '' END AS uri,
         CAST(strlen(text) AS BIGINT) AS size
  FROM documents
)
SELECT uri, size FROM f WHERE regexp_matches(lower(uri), '(\\.pdf|\\.txt)$')""")
def q_list_files(spark, sf_dir):
    """Objects of a corpus whose lower-cased name ends with .pdf or
    .txt (case kept in the uri); .md objects are skipped."""
    from ..sources.files import with_extensions
    d = read_table(spark, sf_dir, "documents")
    ext = F.lit("")
    for lang, e in reversed(FILE_EXTENSIONS):
        ext = F.when(F.col("lang") == lang, F.lit(e)).otherwise(ext)
    f = d.select(F.concat(F.lit("gs://corpus/"), "source", F.lit("/"),
                          F.col("doc_id").cast("string"), ext).alias("uri"),
                 F.octet_length("text").cast("bigint").alias("size"))
    return with_extensions(f, "uri")
