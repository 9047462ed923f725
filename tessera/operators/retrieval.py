"""Batch retrieval over a chunk / datapoint table.

``retrieve`` embeds a table of queries, finds the exact top-k chunks per
query and returns the hits with their text and provenance; ``context``
folds hits into one ordered text per query, as the single-query tool does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import DEFAULT_DIM, embed_with, tokens, with_sparse_tf
from ..session import staging_path
from .knn import topk_sparse

# --- fixed values -----------------------------------------------------------
DEFAULT_K = 5
NO_DOCUMENTS = "No relevant documents found for the query."
CONTEXT_SEPARATOR = "\n\n"
CONTENT_NAMESPACE = "content"
# ----------------------------------------------------------------------------


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, *,
             dim: int = DEFAULT_DIM, query_id: str = "query_id",
             query_text: str = "text", method: str = "auto", embedder=None,
             chunks_of=None) -> DataFrame:
    """Hits table: (query_id, rank, chunk_id, source, chunk_index, score,
    text). ``chunks`` is (chunk_id, source, chunk_index, text), optionally
    with stored ``buckets, tfs, ss`` vectors (computed with the same
    ``dim``), which are then used as they are. With an ``embedder`` (a pandas
    UDF, text -> vector of unit length) queries are embedded by it and ranked
    by dot product with the chunks' ``feature_vector``, or with its vectors of
    their texts where the table stores none.

    ``chunks_of``, for chunks that are made as they are read and whose ids tell
    their source, gives the chunks of a table of sources (column ``source``): the
    ranked ids (at most k a query) are written once, and only the sources among
    them are chunked again for the texts, not all."""
    base = ["chunk_id", "source", "chunk_index", "text"]
    if embedder is not None:
        from .knn import topk_dense
        c = chunks if "feature_vector" in chunks.columns else \
            embed_with(chunks.select(*base), "text", "feature_vector", embedder)
        top = topk_dense(embed_with(queries.select(query_id, F.col(query_text).alias("_qt")),
                                    "_qt", "_v", embedder),
                         c.select("chunk_id", F.col("feature_vector").alias("_v")), k,
                         query_id=query_id, cand_id="chunk_id", vec="_v")
        return top.join(chunks.select(*base), "chunk_id").select(
            query_id, "rank", "chunk_id", "source", "chunk_index", "score", "text")
    q = with_sparse_tf(queries.select(query_id, F.col(query_text).alias("_qt")),
                       "_qt", dim).drop("_qt")
    if {"buckets", "tfs", "ss"} <= set(chunks.columns):
        # a stored vector table (e.g. the ingest output): vectors are reused
        c = chunks.select(*base, "buckets", "tfs", "ss")
    elif method == "join":
        c = with_sparse_tf(chunks.select(*base), "text", dim)
    else:
        c = chunks.select(*base, tokens(F.col("text")).alias("tokens"))
    if chunks_of is not None:
        # written as files, whose size the planner knows when it joins them
        path = staging_path(queries.sparkSession, "hits")
        top = topk_sparse(q, c, k, dim, query_id=query_id, cand_id="chunk_id", beside=("source",),
                          method=method)
        top.write.parquet(path)
        top = queries.sparkSession.read.schema(top.schema).parquet(path)
        hit = chunks_of(top.select("source").distinct()).select(*base)
        return top.drop("source").join(hit, "chunk_id").select(
            query_id, "rank", "chunk_id", "source", "chunk_index", "score", "text")
    hits = topk_sparse(q, c, k, dim, query_id=query_id, cand_id="chunk_id",
                       carry=("source", "chunk_index", "text"), method=method)
    return hits.select(query_id, "rank", "chunk_id", "source", "chunk_index",
                       "score", "text")


def context(queries: DataFrame, hits: DataFrame, *, query_id: str = "query_id",
            text_col: str = "text") -> DataFrame:
    """One row per query: (query_id, hits, top_score, context, sources).

    ``context`` joins hit texts in rank order with a blank line; a query
    without hits gets the fixed "no documents" message. ``sources`` lists
    ``source#chunk_index`` in rank order, one per line (J8). The
    ``collect_list`` is bounded by k per query.
    """
    agg = (hits.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("rank"), F.col(text_col).alias("t"),
            F.concat(F.col("source"), F.lit("#"),
                     F.col("chunk_index").cast("string")).alias("s")))).alias("_h"),
        F.max("score").alias("top_score")))
    agg = agg.select(
        query_id,
        F.size("_h").alias("hits"), "top_score",
        F.array_join(F.transform("_h", lambda x: x["t"]), CONTEXT_SEPARATOR).alias("context"),
        F.array_join(F.transform("_h", lambda x: x["s"]), "\n").alias("sources"))
    return (queries.select(query_id).join(agg, query_id, "left")
            .select(query_id,
                    F.coalesce("hits", F.lit(0)).alias("hits"),
                    "top_score",
                    F.coalesce("context", F.lit(NO_DOCUMENTS)).alias("context"),
                    F.coalesce("sources", F.lit("")).alias("sources")))


def datapoint_content(restricts: Column, crowding: Column) -> Column:
    """Text stored with a datapoint (F4): the first value of the first
    ``content`` restrict with a non-empty allow list; if that is empty or
    missing, the crowding attribute unless it is '' or '0'; else null."""
    first = F.get(F.filter(restricts, lambda r: (r["namespace"] == CONTENT_NAMESPACE)
                           & (F.size(r["allow_list"]) > 0)), 0)
    val = F.get(first["allow_list"], 0)
    return F.coalesce(F.nullif(val, F.lit("")),
                      F.when(~crowding.isin("", "0"), crowding))


def retrieve_datapoints(query_vectors: DataFrame, datapoints: DataFrame,
                        k: int = DEFAULT_K, *, query_id: str = "query_id") -> DataFrame:
    """Top-k over a datapoint table (datapoint_id, feature_vector, restricts,
    crowding_attribute); rows without content are dropped after ranking, as
    the reference drops them from the neighbour list (F4)."""
    from .knn import topk_dense
    top = topk_dense(query_vectors.select(query_id, F.col("feature_vector").alias("v")),
                     datapoints.select("datapoint_id", F.col("feature_vector").alias("v")),
                     k, query_id=query_id, cand_id="datapoint_id", vec="v")
    dp = datapoints.select("datapoint_id", datapoint_content(
        F.col("restricts"), F.col("crowding_attribute")).alias("content"))
    return (top.join(dp, "datapoint_id").where(F.col("content").isNotNull()))
