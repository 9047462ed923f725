"""Bindings that go through files and stores: the driver tables are written as
text objects, mapping versions, partitioned stores, datapoint tables, JSON and
session tables under the shared checkpoint folder, read back by the library's
readers, and compared whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunking import corpus_chunks
from ..operators.ingest import chunk_vectors
from ..operators.retrieval import datapoint_content
from ..operators.upsert import datapoints, merge
from ..session import staging_path
from ..sources.buckets import load_bucketed, upsert_bucketed
from ..sources.files import extract_pages, list_files, pages_to_text, read_corpus, read_text_files
from ..sources.mapping import (export_mapping_json, load_datapoints, load_mapping, load_partitioned,
                               save_datapoints, save_mapping, upsert_partitioned)
from ..sources.sessions import normalize_sessions, read_sessions
from ..sources.tables import read_table, read_text_table
from . import sqlparts as S
from .registry import query

PAGE_BREAK = "\f"
# Rows of one text object: readers hold an object whole.
OBJECT_ROWS = 256
_FLAT = "replace(replace(replace(text, chr(10), ' '), chr(12), ' '), chr(65533), '')"


def _written(spark, sf_dir, separator: str) -> str:
    """Documents as text objects, up to ``OBJECT_ROWS`` to a file, ended by
    ``separator``."""
    d = read_text_table(spark, sf_dir, "documents")
    flat = F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(PAGE_BREAK), F.lit(" ")),
                     F.lit("�"), F.lit(""))
    root = staging_path(spark, "text-objects")
    d.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), flat).alias("value")) \
        .write.option("lineSep", separator).option("maxRecordsPerFile", OBJECT_ROWS).text(root)
    return root


def _rows(texts):
    """(doc_id, text) of the lines of the objects' texts."""
    line = F.explode(F.split("text", "\n"))
    return texts.select(line.alias("l")).where("l <> ''").select(
        F.substring_index("l", "\t", 1).cast("long").alias("doc_id"),
        F.expr("substr(l, instr(l, '\t') + 1)").alias("text"))


@query("text_objects", sql=f"SELECT doc_id, {_FLAT} AS text FROM documents")
def q_text_objects(spark, sf_dir):
    """Text objects listed by extension, read and decoded."""
    root = _written(spark, sf_dir, "\n")
    listed = list_files(spark, root, (".TXT",)).where("length > 0").select("uri")
    return _rows(read_text_files(spark, root).join(listed, "uri", "left_semi"))


@query("paged_objects", sql=f"SELECT doc_id, {_FLAT} AS text FROM documents")
def q_paged_objects(spark, sf_dir):
    """Objects of many pages through a caller's extractor, the pages
    joined in order."""
    files = read_corpus(spark, _written(spark, sf_dir, PAGE_BREAK), (".txt",))
    pages = extract_pages(files, lambda data: data.decode().split(PAGE_BREAK)[:-1])
    return _rows(pages_to_text(pages))


# --- stores: a first ingest, then one that adds and changes objects -----------------

_SECOND = "CASE WHEN doc_id % 3 = 1 THEN text ELSE 'again ' || text END"
_AFTER = f"""
documents2 AS (SELECT doc_id, source, {_SECOND} AS text FROM documents),
{S.chunk_ctes(src='documents2')}"""


def _ingests(spark, sf_dir):
    """The chunks of both ingests: objects 0 and 1 mod 3 first; 0 mod 3 changed and 2
    mod 3 new in the second."""
    d = read_text_table(spark, sf_dir, "documents")
    third = F.col("doc_id") % 3
    again = d.withColumn("text", F.concat(F.lit("again "), "text"))
    return corpus_chunks(d.where(third != 2)), corpus_chunks(again.where(third != 1))


@query("mapping_versions", sql=f"WITH {_AFTER} SELECT chunk_id, source, chunk_index, text FROM chunks")
def q_mapping_versions(spark, sf_dir):
    """Versions of a mapping store, a changed object's old chunks
    pruned."""
    first, second = _ingests(spark, sf_dir)
    base = staging_path(spark, "mapping-versions")
    save_mapping(first, base)
    save_mapping(merge(load_mapping(spark, base), second, prune_stale=True), base)
    return load_mapping(spark, base)


@query("mapping_parts", sql=f"WITH {_AFTER} SELECT chunk_id, source, chunk_index, text FROM chunks")
def q_mapping_parts(spark, sf_dir):
    """S6 over a store partitioned by object, only the touched partitions
    rewritten."""
    first, second = _ingests(spark, sf_dir)
    base = staging_path(spark, "mapping-parts")
    upsert_partitioned(first, base, 16)
    upsert_partitioned(second, base, 16, prune_stale=True)
    return load_partitioned(spark, base)


@query("mapping_json", sql=f"WITH {S.chunk_ctes()} SELECT chunk_id, source, chunk_index, text FROM chunks")
def q_mapping_json(spark, sf_dir):
    """The mapping exported as JSON lines and read back."""
    path = staging_path(spark, "mapping-json")
    export_mapping_json(corpus_chunks(read_text_table(spark, sf_dir, "documents")), path)
    return spark.read.schema("chunk_id string, source string, chunk_index int, text string").json(path)


@query("datapoint_store", sql=f"""
WITH first_chunks AS (WITH documents1 AS (SELECT * FROM documents WHERE doc_id % 3 <> 2), {S.chunk_ctes(src='documents1')}
                      SELECT chunk_id, text FROM chunks),
second_chunks AS (WITH documents2 AS (SELECT doc_id, source, 'again ' || text AS text FROM documents WHERE doc_id % 3 <> 1),
                  {S.chunk_ctes(src='documents2')} SELECT chunk_id, text FROM chunks)
SELECT chunk_id AS datapoint_id, coalesce(s.text, f.text) AS content
FROM first_chunks f FULL JOIN second_chunks s USING (chunk_id)""")
def q_datapoint_store(spark, sf_dir):
    """Datapoints inserted and replaced by id, their content read back."""
    path = staging_path(spark, "datapoints")
    for chunks in _ingests(spark, sf_dir):
        save_datapoints(datapoints(chunk_vectors(chunks, 16)), path)
    return load_datapoints(spark, path).select(
        "datapoint_id", datapoint_content(F.col("restricts"), F.col("crowding_attribute")).alias("content"))


@query("session_store", sql="""
SELECT event_id AS session_no, 's' || event_id AS session_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS updated_epoch
FROM events WHERE event_id % 2 = 1 AND user_id % 10 = 3""")
def q_session_store(spark, sf_dir):
    """The sessions of one app and user from a session table, their
    payloads read."""
    e = read_table(spark, sf_dir, "events")
    path = staging_path(spark, "session-table")
    n = F.col("event_id").cast("string")
    e.select(F.col("event_id").alias("session_no"),
             F.concat(F.lit("app"), (F.col("event_id") % 2).cast("string")).alias("app_name"),
             (F.col("user_id") % 10).cast("string").alias("user_id"),
             F.concat(F.lit('[{"id": "s'), n, F.lit('", "updated_at": '),
                      F.floor(F.unix_micros("ts") / 1000000).cast("string"), F.lit("}]")).alias("payload")) \
        .write.parquet(path)
    rows = read_sessions(spark, path, "app1", "3")
    return normalize_sessions(rows, keep=("session_no",)).select("session_no", "session_id", "updated_epoch")


@query("mapping_buckets", sql=f"WITH {_AFTER} SELECT chunk_id, source, chunk_index, text FROM chunks")
def q_mapping_buckets(spark, sf_dir):
    """J2, U1, S6 over a store bucketed by object."""
    base = staging_path(spark, "mapping-buckets")
    for chunks in _ingests(spark, sf_dir):
        upsert_bucketed(chunks, base, 16, prune_stale=True)
    return load_bucketed(spark, base)
