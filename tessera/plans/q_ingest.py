"""Ingest and retrieval bindings over ``documents``, ``benchmark`` and
``embeddings``: clean_text, chunk_documents, chunk_ids, embed_chunks,
knn_exact, retrieve_hits, retrieve_context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import DEFAULT_DIM, with_sparse_tf
from ..functions.text import clean_text
from ..operators.chunking import corpus_chunks
from ..operators.knn import topk_dense
from ..operators.retrieval import DEFAULT_K, NO_DOCUMENTS, context, retrieve
from ..sources.tables import read_table, read_text_table
from . import sqlparts as S
from .registry import query


def _queries(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text")


@query("clean_text", sql=f"""
SELECT doc_id, CAST(length({S.clean('text')}) AS BIGINT) AS clean_chars,
       {S.clean('text')} AS clean_text
FROM documents""")
def q_clean_text(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents")
    c = clean_text(F.col("text"))
    return d.select("doc_id", F.length(c).cast("bigint").alias("clean_chars"),
                    c.alias("clean_text"))


@query("chunk_documents", sql=f"""
WITH {S.chunk_ctes()}
SELECT source, chunk_index, text, CAST(length(text) AS BIGINT) AS n_chars FROM chunks""")
def q_chunk_documents(spark, sf_dir):
    ch = corpus_chunks(read_text_table(spark, sf_dir, "documents"))
    return ch.select("source", "chunk_index", "text",
                     F.length("text").cast("bigint").alias("n_chars"))


@query("chunk_ids", sql=f"""
WITH {S.chunk_ctes()}
SELECT chunk_id, source, chunk_index FROM chunks""")
def q_chunk_ids(spark, sf_dir):
    return corpus_chunks(read_text_table(spark, sf_dir, "documents")).select(
        "chunk_id", "source", "chunk_index")


@query("embed_chunks", sql=f"""
WITH {S.chunk_ctes()}, {S.term_ctes('c', 'chunks', 'chunk_id', 'text')}
SELECT t.id AS chunk_id, t.bucket, t.tf,
       CAST(t.tf AS DOUBLE) / sqrt(CAST(s.ss AS DOUBLE)) AS weight
FROM c_tf t JOIN c_ss s USING (id)""")
def q_embed_chunks(spark, sf_dir):
    ch = corpus_chunks(read_text_table(spark, sf_dir, "documents")).select("chunk_id", "text")
    v = with_sparse_tf(ch, "text", DEFAULT_DIM)
    e = v.select("chunk_id", "ss", F.explode(F.arrays_zip("buckets", "tfs")).alias("e"))
    return e.select(
        "chunk_id", F.col("e.buckets").alias("bucket"),
        F.col("e.tfs").cast("bigint").alias("tf"),
        (F.col("e.tfs").cast("double") / F.sqrt(F.col("ss").cast("double"))).alias("weight"))


@query("knn_exact", sql="""
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
)
SELECT query_id, neighbor_id, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 5""")
def q_knn_exact(spark, sf_dir):
    """k nearest neighbours (k=5) of every vector of ``embeddings`` among
    the others: the k-NN graph of the whole table."""
    e = read_table(spark, sf_dir, "embeddings")
    top = topk_dense(e.select(F.col("vec_id").alias("query_id"), "embedding"),
                     e.select("vec_id", "embedding"), 5,
                     query_id="query_id", cand_id="vec_id", vec="embedding",
                     exclude_self=True)
    return top.select("query_id", F.col("vec_id").alias("neighbor_id"), "score",
                      F.col("rank").cast("int").alias("rank"))


_RETRIEVE_SQL = f"""
WITH {S.chunk_ctes()},
{S.term_ctes('c', 'chunks', 'chunk_id', 'text')},
{S.term_ctes('q', 'benchmark', 'item_id', 'text')},
{S.sparse_topk_ctes('q', 'c', DEFAULT_K)},
hits AS (
  SELECT t.query_id, t.rank, t.cand_id AS chunk_id, ch.source, ch.chunk_index, t.score, ch.text
  FROM _top t JOIN chunks ch ON ch.chunk_id = t.cand_id
)"""


@query("retrieve_hits", sql=_RETRIEVE_SQL + """
SELECT query_id, rank, chunk_id, source, chunk_index, score FROM hits""")
def q_retrieve_hits(spark, sf_dir):
    ch = corpus_chunks(read_text_table(spark, sf_dir, "documents"))
    hits = retrieve(_queries(spark, sf_dir), ch, DEFAULT_K)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"),
                       "chunk_id", "source", "chunk_index", "score")


@query("retrieve_context", sql=_RETRIEVE_SQL + f"""
, agg AS (
  SELECT query_id, CAST(count(*) AS BIGINT) AS hits, max(score) AS top_score,
         string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context,
         string_agg(source || '#' || CAST(chunk_index AS VARCHAR), chr(10) ORDER BY rank) AS sources
  FROM hits GROUP BY query_id
)
SELECT b.item_id AS query_id, coalesce(a.hits, 0) AS hits, a.top_score,
       coalesce(a.context, {S.sql_str(NO_DOCUMENTS)}) AS context,
       coalesce(a.sources, '') AS sources
FROM benchmark b LEFT JOIN agg a ON a.query_id = b.item_id""")
def q_retrieve_context(spark, sf_dir):
    """Flagship: retrieval-augmented context for every benchmark text over
    the chunked corpus (C2 + A4 + J8)."""
    q = _queries(spark, sf_dir)
    ch = corpus_chunks(read_text_table(spark, sf_dir, "documents"))
    hits = retrieve(q, ch, DEFAULT_K)
    out = context(q, hits)
    return out.select("query_id", F.col("hits").cast("bigint").alias("hits"),
                      "top_score", "context", "sources")


# --- index table: upsert, datapoint content, ingest summary -----------------
# The increment re-chunks the whole corpus with a wider window (1500/150):
# ids depend only on (uri, position), so positions present in both replace
# the old rows, while a document's old tail positions stay (stale ids).

_UPSERT_CTES = f"""{S.chunk_ctes(1000, 100, 'old_chunks')},
{S.chunk_ctes(1500, 150, 'new_chunks')}"""


def _old_new(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents")
    old = corpus_chunks(d, chunk=1000, overlap=100).withColumn("origin", F.lit("old"))
    new = corpus_chunks(d, chunk=1500, overlap=150).withColumn("origin", F.lit("new"))
    return old, new


def _mapping_out(df):
    return df.select("chunk_id", "source", "chunk_index",
                     F.length("text").cast("bigint").alias("n_chars"), "origin")


@query("upsert_mapping", sql=f"""
WITH {_UPSERT_CTES}
SELECT chunk_id, source, chunk_index, CAST(length(text) AS BIGINT) AS n_chars, 'old' AS origin
FROM old_chunks o WHERE NOT EXISTS (SELECT 1 FROM new_chunks n WHERE n.chunk_id = o.chunk_id)
UNION ALL
SELECT chunk_id, source, chunk_index, CAST(length(text) AS BIGINT), 'new' FROM new_chunks""")
def q_upsert_mapping(spark, sf_dir):
    from ..operators.upsert import merge
    old, new = _old_new(spark, sf_dir)
    return _mapping_out(merge(old, new))


@query("upsert_prune", sql=f"""
WITH {_UPSERT_CTES}
SELECT chunk_id, source, chunk_index, CAST(length(text) AS BIGINT) AS n_chars, 'old' AS origin
FROM old_chunks o WHERE NOT EXISTS (SELECT 1 FROM new_chunks n WHERE n.source = o.source)
UNION ALL
SELECT chunk_id, source, chunk_index, CAST(length(text) AS BIGINT), 'new' FROM new_chunks""")
def q_upsert_prune(spark, sf_dir):
    from ..operators.upsert import merge
    old, new = _old_new(spark, sf_dir)
    return _mapping_out(merge(old, new, prune_stale=True))


@query("datapoint_content", sql="""
WITH dp AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS datapoint_id,
         CASE WHEN l.quality = 1 THEN [d.text] ELSE [] END AS allow_list,
         CAST(e.label AS VARCHAR) AS crowding_attribute
  FROM embeddings e
  LEFT JOIN documents d ON d.doc_id = e.vec_id
  LEFT JOIN labels l ON l.doc_id = e.vec_id
)
SELECT datapoint_id,
       coalesce(nullif(CASE WHEN len(allow_list) > 0 THEN allow_list[1] END, ''),
                CASE WHEN crowding_attribute NOT IN ('', '0') THEN crowding_attribute END) AS content
FROM dp
WHERE coalesce(nullif(CASE WHEN len(allow_list) > 0 THEN allow_list[1] END, ''),
               CASE WHEN crowding_attribute NOT IN ('', '0') THEN crowding_attribute END) IS NOT NULL""")
def q_datapoint_content(spark, sf_dir):
    """Datapoints built from ``embeddings``: a ``label`` restrict, then a
    ``content`` restrict holding the document text when the document is
    labelled quality=1 (else an empty allow list), crowding = label. F4
    picks the content."""
    from ..operators.retrieval import datapoint_content
    e = read_table(spark, sf_dir, "embeddings")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    dp = (e.join(d, e["vec_id"] == d["doc_id"], "left").drop("doc_id")
          .join(lab, e["vec_id"] == lab["doc_id"], "left")
          .select(
              F.col("vec_id").cast("string").alias("datapoint_id"),
              F.array(
                  F.struct(F.lit("label").alias("namespace"),
                           F.array(F.col("label").cast("string")).alias("allow_list")),
                  F.struct(F.lit("content").alias("namespace"),
                           F.when(F.col("quality") == 1, F.array("text"))
                           .otherwise(F.array().cast("array<string>")).alias("allow_list")),
              ).alias("restricts"),
              F.col("label").cast("string").alias("crowding_attribute")))
    out = dp.select("datapoint_id", datapoint_content(
        F.col("restricts"), F.col("crowding_attribute")).alias("content"))
    return out.where(F.col("content").isNotNull())


@query("ingest_summary", sql=f"""
WITH {S.chunk_ctes()},
per_doc AS (SELECT source, count(*) AS n FROM chunks GROUP BY source)
SELECT CAST(count(*) AS BIGINT) AS files_found,
       CAST(sum(CASE WHEN length({S.clean('d.text')}) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS files_without_text,
       CAST(coalesce(sum(p.n), 0) AS BIGINT) AS chunks
FROM documents d LEFT JOIN per_doc p ON p.source = {S.corpus_uri('d.source', 'd.doc_id')}""")
def q_ingest_summary(spark, sf_dir):
    """A8 run summary of ingesting the whole corpus (files found, files with
    no text, chunks written)."""
    from ..operators.chunking import CORPUS_PREFIX, corpus_uri
    from ..operators.ingest import plan_ingest
    d = read_text_table(spark, sf_dir, "documents")
    texts = d.select(corpus_uri(F.col("source"), F.col("doc_id")).alias("uri"), "text")
    return plan_ingest(texts, CORPUS_PREFIX).summary


# --- approximate k-NN -------------------------------------------------------
# Share of the cells probed and of the vectors read exactly per query.
PQ_PROBES = 0.75
PQ_RERANK = 0.1


@query("knn_approx")
def q_knn_approx(spark, sf_dir):
    """Approximate k-NN graph of ``embeddings`` by product-quantised codes
    with exact re-ranking (rows-only check; recall is tested against exact):
    (query_id, neighbor_id, score, rank)."""
    from ..operators import pq
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = pq.train(e)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    top = pq.search(q, e, pq.index(e, model), model, 5, max(1, int(PQ_PROBES * len(model.centroids))),
                    max(50, int(PQ_RERANK * e.count())), exclude_self=True)
    return top.select("query_id", F.col("vec_id").alias("neighbor_id"), "score",
                      F.col("rank").cast("int").alias("rank"))


@query("knn_reranked", sql="""
SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
       round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(
            CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS INTEGER) AS rank
FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id QUALIFY rank <= 5""")
def q_knn_reranked(spark, sf_dir):
    """T7's exact re-ranking, over candidates given by an equal label."""
    from ..operators.pq import reranked
    e = read_table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("query_id"), "label"), e.select("vec_id", "label")
    top = reranked(pairs, e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 5, exclude_self=True)
    return top.select("query_id", F.col("vec_id").alias("neighbor_id"), "score",
                      F.col("rank").cast("int").alias("rank"))
