"""Incremental corpus ingest.

``sync_corpus`` compares a prefix with the stored manifest and ingests what is
new or changed and removes what is gone: old chunks of a changed or deleted
object leave the mapping and the datapoints. ``start_sync_stream`` repeats it
as a stream's micro-batches.

``start_ingest_stream`` is the lighter form for prefixes that only gain objects:
a ``binaryFile`` file stream (which takes a path once); each micro-batch is
chunked and merged into the mapping store as a new version (keyed upsert, so a
re-delivered batch after a failure writes the same ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import DEFAULT_DIM
from ..operators.chunking import chunk_table
from ..operators.ingest import chunk_vectors
from ..operators.upsert import datapoints, merge
from ..session import checkpoint_dir
from ..sources.files import DEFAULT_EXTENSIONS, _ext_pattern, decode_text, extract_pages, pages_to_text
from ..sources.manifest import DELETED, save_manifest, scan
from ..sources.mapping import load_mapping, save_datapoints, save_mapping, upsert_partitioned


# the fixed schema of the binaryFile source (streams need it declared)
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str,
                exts: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    s = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
         .option("recursiveFileLookup", "true").load(root))
    return (s.where(F.lower("path").rlike(_ext_pattern(exts)))
            .select(F.col("path").alias("uri"), "content"))


def sync_corpus(spark: SparkSession, root: str, prefix: str, mapping_store: str, manifest: str,
                datapoint_path: str | None = None, extractor=None, dim: int = DEFAULT_DIM,
                embedder=None) -> dict:
    """Bring the mapping (and datapoints) up to date with the objects below
    ``root``. Returns the numbers of objects new, changed and deleted. Nothing
    is written when there are none; the manifest is saved last, so a step that
    fails is repeated, with the same ids."""
    checkpoint_dir(spark)
    changed, files, following = scan(spark, root, manifest)
    changed = changed.checkpoint()
    counts = {r["status"]: r["count"] for r in changed.groupBy("status").count().collect()}
    summary = {s: counts.get(s, 0) for s in ("new", "changed", DELETED)}
    if changed.isEmpty():
        return summary
    is_pdf = F.lower("uri").endswith(".pdf")
    texts = files.where(~is_pdf).select("uri", decode_text(F.col("content")).alias("text"))
    if extractor is not None:
        texts = texts.unionByName(pages_to_text(extract_pages(files.where(is_pdf), extractor)))
    chunks = chunk_table(texts, "uri", "text", prefix).checkpoint()
    stored = load_mapping(spark, mapping_store)
    gone = stored.join(changed.select(F.col("uri").alias("source")), "source", "left_semi")
    gone = gone.select(F.col("chunk_id").alias("datapoint_id")).checkpoint()
    kept = stored.join(changed.select(F.col("uri").alias("source")), "source", "left_anti")
    new = chunks.select("chunk_id", "source", "chunk_index", "text")
    if datapoint_path:
        save_datapoints(datapoints(chunk_vectors(chunks, dim, embedder)), datapoint_path, drop=gone)
    save_mapping(kept.select(new.columns).unionByName(new), mapping_store)
    save_manifest(following, manifest)
    return summary


def start_sync_stream(spark: SparkSession, root: str, prefix: str, mapping_store: str, manifest: str,
                      checkpoint: str, every: str = "1 minute", **kw):
    """``sync_corpus`` every ``every``, as a StreamingQuery; ``kw`` as there. A
    sync runs only after the one before it has ended."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(batch: DataFrame, batch_id: int) -> None:
        sync_corpus(spark, root, prefix, mapping_store, manifest, **kw)

    return (clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())


def start_ingest_stream(spark: SparkSession, root: str, prefix: str, mapping_store: str,
                        checkpoint: str, trigger_once: bool = True,
                        prune_stale: bool = False, partitioned: bool = False):
    """Start the stream; returns the StreamingQuery. Text objects only
    (PDFs need an extractor and go through the batch ingest). With
    ``partitioned=True`` each micro-batch rewrites only the mapping
    partitions of its objects instead of writing a full new version."""
    files = file_stream(spark, root, (".txt",))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        texts = batch.select("uri", decode_text(F.col("content")).alias("text"))
        chunks = chunk_table(texts, "uri", "text", prefix)
        new = chunks.select("chunk_id", "source", "chunk_index", "text")
        if new.isEmpty():
            return
        if partitioned:
            upsert_partitioned(new, mapping_store, prune_stale=prune_stale)
            return
        merged = merge(load_mapping(spark, mapping_store), new, prune_stale=prune_stale)
        save_mapping(merged, mapping_store)

    w = (files.writeStream.foreachBatch(upsert)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
