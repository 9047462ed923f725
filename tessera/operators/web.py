"""Web search over stored pages.

The remote search service of the reference is re-aimed as BM25 ranking over
a page table, its page fetch as a join with that table.

BM25 plan: per-page term counts are computed per row (no shuffle) and packed
into blocks of postings (:mod:`tessera.operators.postings`). Document frequencies
are a grouped count of the terms that occur in queries (map-side partial counts,
so a term present in every page is no hot spot); they and the corpus totals
reach the queries by a join and a scalar subquery. Blocks of queries then meet
the blocks of postings once on the grid. One plan at every size: nothing is
collected and nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

from ..functions.embed import term_counts, tokens
from ..functions.html import (extract_urls, host, page_lang, page_output, page_text,
                              site_match, title)
from ..functions.text import clean_field
from . import postings
from .knn import _final_topk, _rounding_margin

# --- fixed values -----------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
DEFAULT_RESULTS = 3
MAX_RESULTS = 10
SNIPPET_CHARS = 160
NO_RESULTS = "No results found."
NO_URLS = "No URLs found in the provided search results text."
PAGE_SEPARATOR = "\n\n" + "-" * 40 + "\n\n"
DEFAULT_TOP_PAGES = 3
SCORE_DIGITS = 6
# ----------------------------------------------------------------------------


SITE_QUERY = r"^\s*site:(\S+)\s+(.*)$"


def split_site_query(q: Column) -> tuple[Column, Column]:
    """``site:host rest`` -> (site, rest); other queries -> (null, q)."""
    s = F.nullif(F.lower(F.regexp_extract(q, "(?s)" + SITE_QUERY, 1)), F.lit(""))
    rest = F.when(s.isNotNull(), F.regexp_extract(q, "(?s)" + SITE_QUERY, 2)).otherwise(q)
    return s.alias("_site"), rest.alias("_q")


def clamp_results(n: int) -> int:
    """Result count clamp (T5): between 1 and 10."""
    return max(1, min(int(n), MAX_RESULTS))


def doc_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl) per document, from per-row term counts."""
    tc = docs.select(id_col, term_counts(tokens(F.col(text_col))).alias("_tc"))
    return (tc.select(id_col, F.col("_tc.dl").alias("dl"),
                      F.explode(F.arrays_zip(F.col("_tc.terms").alias("term"),
                                             F.col("_tc.tfs").alias("tf"))).alias("e"))
            .select(id_col, F.col("e.term").alias("term"), F.col("e.tf").alias("tf"), "dl"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, *, query_id: str = "query_id",
         query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
         k1: float = BM25_K1, b: float = BM25_B, pair_filter=None,
         query_keep: tuple[str, ...] = (), doc_keep: tuple[str, ...] = (),
         doc_tc: str | None = None, site_cols: tuple[str, str] | None = None,
         method: str = "auto") -> DataFrame:
    """Top-k documents per query by BM25 over distinct query terms:
    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``. Returns (query_id,
    doc_id, score, rank); score rounded to 6 places, ties by doc_id.

    ``pair_filter`` (a Column over ``query_keep`` and ``doc_keep`` columns)
    restricts the candidates of each query before the top-k, with corpus
    statistics unchanged -- a search engine's per-query restriction.
    ``doc_tc`` names a column of ``docs`` that already holds
    :func:`term_counts` (a materialised index): nothing is recomputed.
    ``site_cols = (query_site, doc_host)`` is the per-query site
    restriction (host equal to the site or a sub-domain of it).

    Scoring: blocks of postings with bounds, on the grid. ``method="join"``
    (also taken for a ``pair_filter``, which no bound knows) joins the
    document-term rows with the query terms and sums per pair."""
    if k <= 0:
        raise ValueError("k must be positive")
    if site_cols is not None:
        query_keep = tuple(dict.fromkeys(query_keep + (site_cols[0],)))
        doc_keep = tuple(dict.fromkeys(doc_keep + (site_cols[1],)))
    qt = (queries.select(query_id, *query_keep,
                         F.array_distinct(tokens(F.col(query_text))).alias("_t"))
          .select(query_id, *query_keep, F.explode("_t").alias("term")))
    # the per-document term table is computed once (lineage cut into the
    # shared checkpoint folder) and feeds the corpus statistics, the
    # document frequencies and the postings
    if doc_tc is not None:      # an index that already holds the term counts
        tc = docs.select(doc_id, *doc_keep, F.col(doc_tc).alias("_tc"))
    else:
        checkpoint_dir(docs.sparkSession)
        tc = docs.select(doc_id, *doc_keep,
                         term_counts(tokens(F.col(doc_text))).alias("_tc")).checkpoint()
    dt_all = (tc.select(doc_id, *doc_keep, F.col("_tc.dl").alias("dl"),
                        F.explode(F.arrays_zip(F.col("_tc.terms").alias("term"),
                                               F.col("_tc.tfs").alias("tf"))).alias("e"))
              .select(doc_id, *doc_keep, F.col("e.term").alias("term"),
                      F.col("e.tf").alias("tf"), "dl"))
    stats = tc.agg(F.struct(F.count("*").alias("n"), F.avg(F.col("_tc.dl")).alias("avgdl"))).scalar()
    dt = dt_all.join(qt.select("term").distinct(), "term")
    df = dt.groupBy("term").agg(F.count("*").alias("df"))
    qw = qt.join(df, "term").withColumn("_s", stats).select(
        query_id, *query_keep, "term", F.col("_s.avgdl").alias("avgdl"),
        F.log(F.lit(1.0) + (F.col("_s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if method != "join" and pair_filter is None:
        site = F.col(site_cols[0]) if site_cols else F.lit(None).cast("string")
        packed_queries = qw.groupBy(F.col(query_id).alias("id"), site.alias("site")).agg(
            F.array_sort(F.collect_set(F.struct("term", "idf"))).alias("terms"),
            F.first("avgdl").alias("avgdl"))
        blocks = postings.posting_blocks(tc.select(
            F.col(doc_id).alias("id"),
            (F.col(site_cols[1]) if site_cols else F.lit(None).cast("string")).alias("host"),
            F.col("_tc.dl").alias("dl"), F.col("_tc.terms").alias("terms"),
            F.col("_tc.tfs").alias("tfs")))
        scored = postings.score(packed_queries, blocks, k, tc.schema[doc_id].dataType,
                                query_id=query_id, doc_id=doc_id, k1=k1, b=b,
                                margin=_rounding_margin(SCORE_DIGITS))
        top = _final_topk(scored.withColumn("score", F.round("raw", SCORE_DIGITS)),
                          query_id, doc_id, k)
        return top.select(query_id, doc_id, "score", "rank")
    if site_cols is not None and pair_filter is None:
        qs, dh = F.col(site_cols[0]), F.col(site_cols[1])
        pair_filter = qs.isNull() | (dh == qs) | dh.endswith(F.concat(F.lit("."), qs))
    tf = F.col("tf").cast("double")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    joined = dt.join(qw, "term")
    if pair_filter is not None:
        joined = joined.where(pair_filter)   # per-query restriction, before scoring
    part = joined.select(
        query_id, doc_id, (F.col("idf") * tf * F.lit(k1 + 1.0) / (tf + norm)).alias("w"))
    scores = part.groupBy(query_id, doc_id).agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(doc_id).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page_table(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, lang, text) with cleaned page text."""
    return pages.select("page_id", "url", title(F.col("html")).alias("title"),
                        page_lang(F.col("html")).alias("lang"),
                        page_text(F.col("html")).alias("text"))


PAGE_INDEX_TC = "_tc"


def page_index(pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The search index of a page table, materialised once in the shared
    checkpoint folder: cleaned fields, host and the per-page term counts
    BM25 needs. Build it once and pass it to :func:`web_search` for any
    number of query batches."""
    checkpoint_dir(pages.sparkSession)
    pt = page_table(pages.select("page_id", "url", "html", *extra))
    if extra:
        pt = pt.join(pages.select("page_id", *extra), "page_id")
    return (pt.withColumn("_host", host(F.col("url")))
            .withColumn(PAGE_INDEX_TC, term_counts(tokens(F.col("text")))).checkpoint())


def web_search(queries: DataFrame, pages: DataFrame, num_results: int = DEFAULT_RESULTS, *,
               site: str | None = None, lang: str | None = None,
               recent_days: int | None = None, as_of: Column | None = None,
               unsafe: DataFrame | None = None, query_id: str = "query_id",
               query_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Search a batch of queries over stored pages (C3). ``pages`` is the
    raw page table (page_id, url, html[, fetched_at]) or a prebuilt
    :func:`page_index`.

    Filters (site F5, lang F6, recency F7 on ``fetched_at`` relative to an
    explicit ``as_of``, safe F8 as an anti join with ``unsafe`` page ids)
    apply before ranking. Returns (items, texts): items are (query_id, rank,
    title, link, snippet); texts are one numbered results text per query.
    """
    num = clamp_results(num_results)
    # cleaned pages are read for ranking and for the result fields: a page
    # index (one materialisation) unless one is passed in
    extra = ("fetched_at",) if "fetched_at" in pages.columns else ()
    pt = pages if PAGE_INDEX_TC in pages.columns else page_index(pages, extra)
    if site:
        pt = pt.where(site_match(F.col("url"), site))
    if lang:
        pt = pt.where(F.col("lang") == F.lit(lang))
    if recent_days and int(recent_days) > 0:
        if as_of is None or "fetched_at" not in pt.columns:
            raise ValueError("recency filter needs pages.fetched_at and an explicit as_of")
        pt = pt.where(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(int(recent_days))))
    if unsafe is not None:
        pt = pt.join(unsafe.select("page_id"), "page_id", "left_anti")
    # A query may carry its own "site:host rest" prefix
    q = queries.select(query_id, *split_site_query(F.col(query_text)))
    top = bm25(q, pt, num, query_id=query_id, query_text="_q",
               doc_id="page_id", doc_text="text", doc_tc=PAGE_INDEX_TC,
               site_cols=("_site", "_host"))
    items = (top.join(pt.select("page_id", "url", "title", "text"), "page_id")
             .select(query_id, "rank", "page_id", "score",
                     clean_field(F.col("title")).alias("title"),
                     clean_field(F.col("url")).alias("link"),
                     clean_field(F.substr("text", F.lit(1), F.lit(SNIPPET_CHARS)),
                                 newline_to_space=True).alias("snippet")))
    return items, results_text(queries.select(query_id), items, query_id=query_id)


def results_text(queries: DataFrame, items: DataFrame, *, query_id: str = "query_id") -> DataFrame:
    """A5: ``"{i}. {title}\\n{link}\\n{snippet}"`` joined by a blank line,
    in rank order; a query without items gets the fixed message."""
    agg = items.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.format_string("%d. %s\n%s\n%s", F.col("rank"), F.col("title"),
                                F.col("link"), F.col("snippet")).alias("line")))).alias("_l"))
    agg = agg.select(query_id, F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n")
                     .alias("results_text"), F.size("_l").alias("n_results"))
    return (queries.join(agg, query_id, "left")
            .select(query_id, F.coalesce("n_results", F.lit(0)).alias("n_results"),
                    F.coalesce("results_text", F.lit(NO_RESULTS)).alias("results_text")))


def fetch_pages(results: DataFrame, pages: DataFrame, top_n: int = DEFAULT_TOP_PAGES,
                max_chars: int = 8000, *, key: str = "query_id",
                text_col: str = "results_text") -> DataFrame:
    """C4: read the first ``top_n`` URLs of each results text from the page
    table. (key, urls, bundle): each URL's block is its cleaned page (or a
    status line), blocks joined by a dashed separator, in URL order."""
    urls = results.select(key, F.posexplode(extract_urls(F.col(text_col), top_n))
                          .alias("pos", "url"))
    # restrict the page table to the requested URLs first (an inner join:
    # AQE broadcasts the small URL side), so only those pages are cleaned
    # and the big side is never shuffled; then attach pages back to URLs
    wanted = urls.select("url").distinct()
    # a URL stored more than once is read once: the page with the least id
    # (without ids, the lesser html)
    first = F.min_by("html", "page_id") if "page_id" in pages.columns else F.min("html")
    kept = [c for c in ("page_id",) if c in pages.columns]
    pt = (pages.select("url", "html", *kept).join(wanted, "url").groupBy("url")
          .agg(first.alias("html")).select("url", page_text(F.col("html")).alias("ptext")))
    blocks = (urls.join(pt, "url", "left")
              .select(key, "pos", "url", page_output(F.col("url"), F.col("ptext"), max_chars)
                      .alias("block")))
    agg = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "url", "block")))
                                  .alias("_b"))
    agg = agg.select(key, F.array_join(F.transform("_b", lambda x: x["url"]), "\n").alias("urls"),
                     F.concat(F.lit("\n\n"), F.array_join(F.transform("_b", lambda x: x["block"]),
                                                          PAGE_SEPARATOR)).alias("bundle"))
    return (results.select(key).join(agg, key, "left")
            .select(key, F.coalesce("urls", F.lit("")).alias("urls"),
                    F.coalesce("bundle", F.lit(NO_URLS)).alias("bundle")))


def safe_rows(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """F8: drop rows labelled toxic (anti join; labels are one row per id)."""
    return rows.join(labels.where(F.col("toxic") == 1).select(key), key, "left_anti")


def fallback(queries: DataFrame, internal_hits: DataFrame, web_items: DataFrame,
             min_score: float, *, query_id: str = "query_id") -> DataFrame:
    """Internal hits for queries that have one scoring at least
    ``min_score``; web items for the others; tagged by ``tier``."""
    good = internal_hits.where(F.col("score") >= min_score).select(query_id).distinct()
    internal = (internal_hits.join(good, query_id)
                .select(query_id, F.lit("internal").alias("tier"), "rank",
                        F.col("chunk_id").alias("ref"), "score"))
    need_web = queries.select(query_id).join(good, query_id, "left_anti")
    web = (web_items.join(need_web, query_id)
           .select(query_id, F.lit("web").alias("tier"), "rank",
                   F.col("link").alias("ref"), "score"))
    return internal.unionByName(web)
