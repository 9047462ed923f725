"""Keyed upsert of chunk/datapoint tables.

``merge`` keeps every existing row whose key is not in the increment and
adds the increment: one anti join (a shuffle on the key, or a broadcast of
the increment's keys when AQE sees they are small) plus a union. Stale keys
stay, as in the reference (a file that shrank keeps its old tail chunks);
``prune_stale=True`` instead drops every existing row of a re-ingested
source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
UPSERT_BATCH = 100   # datapoints per call to an external index
# ----------------------------------------------------------------------------


def merge(existing: DataFrame, new: DataFrame, key: str = "chunk_id",
          prune_stale: bool = False, source_col: str = "source") -> DataFrame:
    cols = existing.columns
    if prune_stale:
        kept = existing.join(new.select(source_col).distinct(), source_col, "left_anti")
    else:
        kept = existing.join(new.select(key), key, "left_anti")
    return kept.select(*cols).unionByName(new.select(*cols))


def upsert_batches(df: DataFrame, send: Callable[[list], None],
                   batch: int = UPSERT_BATCH) -> None:
    """Push rows to an external index in slices of ``batch`` rows, from every
    partition in parallel (``send`` receives a list of Row). A partition that
    fails is retried by Spark; ``send`` must be idempotent (ids are
    deterministic, so an insert-or-replace index is)."""
    if batch <= 0:
        raise ValueError("batch must be positive")

    def run(rows: Iterable) -> None:
        buf = []
        for r in rows:
            buf.append(r)
            if len(buf) >= batch:
                send(buf)
                buf = []
        if buf:
            send(buf)

    df.foreachPartition(run)


def datapoints(chunks: DataFrame, vector_col: str = "feature_vector") -> DataFrame:
    """Datapoint rows (M4) from chunks with a vector: the chunk text goes in
    a ``content`` restrict, as the reference stores it."""
    return chunks.select(
        F.col("chunk_id").alias("datapoint_id"),
        F.col(vector_col).alias("feature_vector"),
        F.array(F.struct(F.lit("content").alias("namespace"),
                         F.array(F.col("text")).alias("allow_list"))).alias("restricts"),
        F.lit(None).cast("string").alias("crowding_attribute"))
