"""Answer context over both tiers (C10, J7): internal chunks for the queries that
have a good one, stored web pages for the others.

Two steps: the internal hits are fixed first (written once), and only the
queries that lack a hit of ``min_score`` are searched, fetched and bundled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .retrieval import DEFAULT_K, context, retrieve
from .web import DEFAULT_RESULTS, DEFAULT_TOP_PAGES, fetch_pages, web_search


def answer_context(queries: DataFrame, chunks: DataFrame, pages: DataFrame, min_score: float,
                   k: int = DEFAULT_K, results: int = DEFAULT_RESULTS,
                   top_pages: int = DEFAULT_TOP_PAGES, *, query_id: str = "query_id",
                   query_text: str = "text", embedder=None, chunks_of=None, **search) -> DataFrame:
    """(query_id, tier, context, sources), one row per query. Tier ``internal``:
    the hits' texts and ``source#chunk`` lines, in rank order; tier ``web``: the
    bundle of the pages found and their URLs, or the fixed message. ``search``
    goes to :func:`web.web_search` (site, lang, recent_days, ...); ``chunks_of`` to
    :func:`retrieval.retrieve`."""
    checkpoint_dir(queries.sparkSession)
    q = queries.select(query_id, query_text)
    hits = retrieve(q, chunks, k, query_id=query_id, query_text=query_text, embedder=embedder,
                    chunks_of=chunks_of).checkpoint()
    good = hits.where(F.col("score") >= min_score).select(query_id).distinct()
    inner = context(good, hits.join(good, query_id, "left_semi"), query_id=query_id)
    lacking = q.join(good, query_id, "left_anti")
    _, texts = web_search(lacking, pages, results, query_id=query_id, query_text=query_text, **search)
    outer = fetch_pages(texts, pages, top_pages, key=query_id)
    return inner.select(query_id, F.lit("internal").alias("tier"), "context", "sources").unionByName(
        outer.select(query_id, F.lit("web").alias("tier"), F.col("bundle").alias("context"),
                     F.col("urls").alias("sources")))
