"""Corpus ingest (C1, A8): files or documents -> chunks -> vectors ->
datapoints + merged mapping -> summary.

``plan_ingest`` only builds DataFrames; ``run_ingest`` writes them. The work
is map-only up to the upsert (clean, chunk, id, embed per row), then one
shuffle on ``chunk_id`` for the keyed merge. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import DEFAULT_DIM, dense_vector, embed_with, with_sparse_tf
from ..functions.text import DEFAULT_CHUNK_CHARS, DEFAULT_CHUNK_OVERLAP, clean_text
from ..sources.files import decode_text, extract_pages, pages_to_text, read_corpus
from ..sources.mapping import load_mapping, save_datapoints, save_mapping, upsert_partitioned
from .chunking import chunk_table
from .upsert import datapoints, merge


@dataclass
class IngestPlan:
    chunks: DataFrame        # chunk_id, source, chunk_index, text
    vectors: DataFrame       # chunks + buckets, tfs, ss, feature_vector
    datapoints: DataFrame    # M4 rows
    mapping: DataFrame       # existing mapping merged with the new chunks
    summary: DataFrame       # one row: files_found, files_without_text, chunks


def texts_from_files(spark: SparkSession, root: str, extractor=None) -> DataFrame:
    """(uri, text) of the .txt and .pdf objects below ``root``. PDFs need an
    ``extractor`` (bytes -> page texts); without one they yield no text."""
    files = read_corpus(spark, root)
    is_pdf = F.lower("uri").endswith(".pdf")
    txt = files.where(~is_pdf).select("uri", decode_text(F.col("content")).alias("text"))
    if extractor is None:
        pdf = files.where(is_pdf).select("uri", F.lit("").alias("text"))
    else:
        pdf = pages_to_text(extract_pages(files.where(is_pdf), extractor))
    return txt.unionByName(pdf)


def plan_ingest(texts: DataFrame, prefix: str, existing: DataFrame | None = None, *,
                chunk: int = DEFAULT_CHUNK_CHARS, overlap: int = DEFAULT_CHUNK_OVERLAP,
                dim: int = DEFAULT_DIM, prune_stale: bool = False, embedder=None) -> IngestPlan:
    """``texts``: (uri, text), one row per object found under ``prefix``.
    ``embedder`` (a pandas UDF, text -> vector) replaces the hashed vectors."""
    chunks = chunk_table(texts, "uri", "text", prefix, chunk, overlap)
    vecs = chunk_vectors(chunks, dim, embedder)
    dps = datapoints(vecs)
    new_map = chunks.select("chunk_id", "source", "chunk_index", "text")
    mapping = new_map if existing is None else merge(existing, new_map, prune_stale=prune_stale)
    return IngestPlan(chunks, vecs, dps, mapping, ingest_summary(texts, chunks))


def chunk_vectors(chunks: DataFrame, dim: int = DEFAULT_DIM, embedder=None) -> DataFrame:
    """Chunks with their ``feature_vector``: of the ``embedder``, else hashed
    (then with buckets, tfs, ss too)."""
    if embedder is not None:
        return embed_with(chunks, "text", "feature_vector", embedder)
    return with_sparse_tf(chunks, "text", dim).withColumn(
        "feature_vector", dense_vector(F.col("buckets"), F.col("tfs"), F.col("ss"), dim))


def ingest_summary(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (files_found, files_without_text, chunks)."""
    per_file = texts.select("uri", F.length(clean_text(F.col("text"))).alias("n"))
    counts = chunks.groupBy("source").count()
    return (per_file.join(counts, per_file["uri"] == counts["source"], "left")
            .agg(F.count("*").alias("files_found"),
                 F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).cast("bigint")
                 .alias("files_without_text"),
                 F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("chunks")))


def run_ingest(spark: SparkSession, texts: DataFrame, prefix: str, mapping_store: str,
               datapoint_path: str | None = None, partitioned: bool = False, **kw) -> dict:
    """Ingest and persist. The merged mapping becomes the next version of
    ``mapping_store``, or, with ``partitioned=True``, is upserted into a
    partitioned store rewriting only the partitions of the ingested
    objects. Datapoints are merged by id into ``datapoint_path`` (an external
    index plugs in through :func:`upsert.upsert_batches`). No objects or no chunks
    -> nothing is written."""
    chunk_kw = {k: v for k, v in kw.items() if k in ("chunk", "overlap")}
    dim = kw.get("dim", DEFAULT_DIM)
    prune = kw.get("prune_stale", False)
    # cut lineage once: the chunk table feeds the summary, the mapping and
    # the vectors, and must not be recomputed per output
    chunks = chunk_table(texts, "uri", "text", prefix, **chunk_kw).checkpoint(eager=True)
    summary = ingest_summary(texts, chunks).collect()[0].asDict()
    if summary["chunks"] == 0:
        return {**summary, "written": None}
    new = chunks.select("chunk_id", "source", "chunk_index", "text")
    if partitioned:
        touched = upsert_partitioned(new, mapping_store, prune_stale=prune)
        summary["partitions_rewritten"] = len(touched)
        path = mapping_store
    else:
        merged = merge(load_mapping(spark, mapping_store), new, prune_stale=prune)
        # A8 in flight: rows of the new mapping version, counted during its write
        obs = Observation("mapping_rows")
        path = save_mapping(merged.observe(obs, F.count(F.lit(1)).alias("rows")), mapping_store)
        summary["mapping_rows"] = int(obs.get["rows"])
    if datapoint_path:
        save_datapoints(datapoints(chunk_vectors(chunks, dim, kw.get("embedder"))), datapoint_path)
    return {**summary, "written": path}
