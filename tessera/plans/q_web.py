"""Web bindings over ``pages``, ``documents``, ``labels`` and ``benchmark``:
clean_html, bm25_pages, bm25_documents, web_search, web_search_filtered,
extract_urls, fetch_pages, safe_documents, fallback_tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import (MAX_PAGE_CHARS, URL_PATTERN, URL_TRAILING_PATTERN,
                              page_output, page_text)
from ..operators.web import (DEFAULT_TOP_PAGES, NO_RESULTS, NO_URLS, PAGE_SEPARATOR,
                             SNIPPET_CHARS, bm25, fetch_pages, safe_rows, web_search)
from ..sources.tables import read_table, read_text_table
from . import sqlparts as S
from .registry import query

SEARCH_RESULTS = 3       # the reference's default result count
FILTER_SITE = "example.com"
FILTER_LANG = "en"
FILTER_RESULTS = 5
FALLBACK_MIN_SCORE = 0.55


def _queries(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text")


@query("clean_html", sql=f"""
WITH p AS (SELECT page_id, url, {S.page_text('html')} AS text FROM pages)
SELECT page_id, url, CAST(length(text) AS BIGINT) AS clean_chars,
       {S.page_output('url', 'text', MAX_PAGE_CHARS)} AS page_text
FROM p""")
def q_clean_html(spark, sf_dir):
    p = read_text_table(spark, sf_dir, "pages").select(
        "page_id", "url", page_text(F.col("html")).alias("text"))
    return p.select("page_id", "url", F.length("text").cast("bigint").alias("clean_chars"),
                    page_output(F.col("url"), F.col("text"), MAX_PAGE_CHARS).alias("page_text"))


_PT = f"_pt AS (SELECT page_id, url, {S.title('html')} AS title, {S.page_lang('html')} AS lang, {S.page_text('html')} AS text FROM pages)"


@query("bm25_pages", sql=f"""
WITH {_PT}, {S.bm25_ctes('benchmark', 'item_id', 'text', '_pt', 'page_id', 'text', 10)}
SELECT query_id, doc_id AS page_id, score, rank FROM bm_top""")
def q_bm25_pages(spark, sf_dir):
    pt = read_text_table(spark, sf_dir, "pages").select(
        "page_id", page_text(F.col("html")).alias("text"))
    r = bm25(_queries(spark, sf_dir), pt, 10, doc_id="page_id")
    return r.select("query_id", "page_id", "score", F.col("rank").cast("int").alias("rank"))


@query("bm25_documents", sql=f"""
WITH {S.bm25_ctes('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text', 10)}
SELECT query_id, doc_id, score, rank FROM bm_top""")
def q_bm25_documents(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents").select("doc_id", "text")
    r = bm25(_queries(spark, sf_dir), d, 10, doc_id="doc_id")
    return r.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def _search_sql(n: int, where: str = "") -> str:
    """CTEs through ``results(query_id, n_results, results_text)``."""
    return f"""{_PT},
_ptf AS (SELECT * FROM _pt {where}),
{S.bm25_ctes('benchmark', 'item_id', 'text', '_ptf', 'page_id', 'text', n)},
items AS (
  SELECT t.query_id, t.rank, t.doc_id AS page_id, t.score,
         {S.strip("coalesce(p.title, '')")} AS title, {S.strip("coalesce(p.url, '')")} AS link,
         {S.strip(f"replace(coalesce(substr(p.text, 1, {SNIPPET_CHARS}), ''), chr(10), ' ')")} AS snippet
  FROM bm_top t JOIN _ptf p ON p.page_id = t.doc_id
),
agg AS (
  SELECT query_id, CAST(count(*) AS INTEGER) AS n_results,
         string_agg(CAST(rank AS VARCHAR) || '. ' || title || chr(10) || link || chr(10) || snippet,
                    chr(10) || chr(10) ORDER BY rank) AS results_text
  FROM items GROUP BY query_id
),
results AS (
  SELECT b.item_id AS query_id, coalesce(a.n_results, 0) AS n_results,
         coalesce(a.results_text, {S.sql_str(NO_RESULTS)}) AS results_text
  FROM benchmark b LEFT JOIN agg a ON a.query_id = b.item_id
)"""


@query("web_search", sql=f"WITH {_search_sql(SEARCH_RESULTS)} SELECT * FROM results")
def q_web_search(spark, sf_dir):
    """Numbered results text (3 results) for every benchmark query over all
    stored pages (C3, A5)."""
    _, texts = web_search(_queries(spark, sf_dir), read_text_table(spark, sf_dir, "pages"),
                          SEARCH_RESULTS)
    return texts


_FILTER_WHERE = (f"WHERE lang = {S.sql_str(FILTER_LANG)} AND ({S.host('url')} = "
                 f"{S.sql_str(FILTER_SITE)} OR ends_with({S.host('url')}, "
                 f"{S.sql_str('.' + FILTER_SITE)}))")


@query("web_search_filtered",
       sql=f"WITH {_search_sql(FILTER_RESULTS, _FILTER_WHERE)} SELECT * FROM results")
def q_web_search_filtered(spark, sf_dir):
    """Search restricted to one site (and its sub-domains) and one page
    language, 5 results (F5, F6, T5)."""
    _, texts = web_search(_queries(spark, sf_dir), read_text_table(spark, sf_dir, "pages"),
                          FILTER_RESULTS, site=FILTER_SITE, lang=FILTER_LANG)
    return texts


_URLS_SQL = f"""
_m AS (
  SELECT query_id, generate_subscripts(m, 1) AS pos0, unnest(m) AS raw
  FROM (SELECT query_id, regexp_extract_all(results_text, {S.sql_str(URL_PATTERN)}) AS m FROM results)
),
_u AS (SELECT query_id, pos0, regexp_replace(raw, {S.sql_str(URL_TRAILING_PATTERN)}, '') AS url FROM _m),
_first AS (SELECT query_id, url, min(pos0) AS p FROM _u GROUP BY ALL),
urls AS (
  SELECT query_id, url,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS INTEGER) AS pos
  FROM _first QUALIFY pos < {DEFAULT_TOP_PAGES}
)"""


@query("extract_urls", sql=f"WITH {_search_sql(SEARCH_RESULTS)}, {_URLS_SQL} SELECT * FROM urls")
def q_extract_urls(spark, sf_dir):
    """URLs of each web_search results text, first-occurrence order,
    deduplicated, first 3 (X8, T2)."""
    from ..functions.html import extract_urls
    _, texts = web_search(_queries(spark, sf_dir), read_text_table(spark, sf_dir, "pages"),
                          SEARCH_RESULTS)
    return texts.select("query_id", F.posexplode(extract_urls(
        F.col("results_text"), DEFAULT_TOP_PAGES)).alias("pos", "url"))


@query("fetch_pages", sql=f"""
WITH {_search_sql(SEARCH_RESULTS)}, {_URLS_SQL},
blocks AS (
  SELECT u.query_id, u.pos, u.url,
         {S.page_output('u.url', 'p.text', MAX_PAGE_CHARS)} AS block
  FROM urls u LEFT JOIN (SELECT url, {S.page_text('html')} AS text
                        FROM (SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url)) p ON p.url = u.url
),
bagg AS (
  SELECT query_id, string_agg(url, chr(10) ORDER BY pos) AS urls,
         chr(10) || chr(10) || string_agg(block, {S.sql_str(PAGE_SEPARATOR)} ORDER BY pos) AS bundle
  FROM blocks GROUP BY query_id
)
SELECT r.query_id, coalesce(a.urls, '') AS urls, coalesce(a.bundle, {S.sql_str(NO_URLS)}) AS bundle
FROM results r LEFT JOIN bagg a ON a.query_id = r.query_id""")
def q_fetch_pages(spark, sf_dir):
    """Read the first 3 URLs of each web_search results text from the page
    table (C4, J5, A6)."""
    pages = read_text_table(spark, sf_dir, "pages")
    _, texts = web_search(_queries(spark, sf_dir), pages, SEARCH_RESULTS)
    return fetch_pages(texts, pages, DEFAULT_TOP_PAGES, MAX_PAGE_CHARS)


@query("safe_documents", sql="""
SELECT doc_id, lang, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def q_safe_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return safe_rows(d, read_table(spark, sf_dir, "labels"))


def _fallback_sql() -> str:
    from .q_ingest import _RETRIEVE_SQL
    return _RETRIEVE_SQL + f""", {_search_sql(SEARCH_RESULTS)},
good AS (SELECT DISTINCT query_id FROM hits WHERE score >= {FALLBACK_MIN_SCORE!r})
SELECT h.query_id, 'internal' AS tier, h.rank, h.chunk_id AS ref, h.score
FROM hits h JOIN good g USING (query_id)
UNION ALL
SELECT i.query_id, 'web' AS tier, i.rank, i.link AS ref, i.score
FROM items i WHERE i.query_id NOT IN (SELECT query_id FROM good)"""


@query("fallback_tiers", sql=_fallback_sql())
def q_fallback_tiers(spark, sf_dir):
    """Internal retrieval first; queries whose best internal hit
    scores below 0.55 fall back to web search over the stored pages."""
    from ..operators.chunking import corpus_chunks
    from ..operators.retrieval import DEFAULT_K, retrieve
    from ..operators.web import fallback
    q = _queries(spark, sf_dir)
    hits = retrieve(q, corpus_chunks(read_text_table(spark, sf_dir, "documents")), DEFAULT_K)
    items, _ = web_search(q, read_text_table(spark, sf_dir, "pages"), SEARCH_RESULTS)
    out = fallback(q, hits, items, FALLBACK_MIN_SCORE)
    return out.select("query_id", "tier", F.col("rank").cast("int").alias("rank"), "ref", "score")
