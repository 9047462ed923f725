import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.web import (NO_RESULTS, clamp_results, fetch_pages, results_text,
                                   safe_rows, web_search)


def _page(pid, url, body, lang="en", title="T"):
    return (pid, url, f'<html lang="{lang}"><head><title>{title}</title></head><body>'
                      f'<nav>menu</nav><p>{body}</p><footer>f</footer></body></html>')


PAGES = [
    _page(1, "https://a.example.com/x", "alpha beta gamma"),
    _page(2, "https://b.other.org/y", "alpha alpha delta", lang="de"),
    _page(3, "https://example.com/z", "beta gamma gamma"),
    _page(4, "https://c.example.com/w", "zeta eta"),
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_clamp():
    assert [clamp_results(n) for n in (-3, 0, 1, 3, 10, 11)] == [1, 1, 1, 3, 10, 10]


def test_site_lang_and_site_prefix(spark):
    q = spark.createDataFrame([(1, "alpha gamma"), (2, "site:example.com alpha gamma"),
                               (3, "nothingmatches")], "query_id long, text string")
    items, texts = web_search(q, _pages(spark), 10)
    got = {}
    for r in items.collect():
        got.setdefault(r.query_id, []).append(r.link)
    assert set(got[1]) == {"https://a.example.com/x", "https://b.other.org/y", "https://example.com/z"}
    assert set(got[2]) == {"https://a.example.com/x", "https://example.com/z"}
    t = {r.query_id: r.results_text for r in texts.collect()}
    assert t[3] == NO_RESULTS
    items, _ = web_search(q, _pages(spark), 10, site="site:example.com", lang="en")
    assert {r.link for r in items.collect()} <= {"https://a.example.com/x", "https://example.com/z"}


def test_recency_and_safe(spark):
    pages = _pages(spark).withColumn("fetched_at", F.when(F.col("page_id") == 1, F.lit(dt.datetime(2024, 1, 10)))
                                     .when(F.col("page_id") == 3, F.lit(dt.datetime(2024, 1, 3)))
                                     .otherwise(F.lit(dt.datetime(2023, 1, 1))))
    q = spark.createDataFrame([(1, "alpha beta gamma")], "query_id long, text string")
    as_of = F.lit(dt.datetime(2024, 1, 10))
    items, _ = web_search(q, pages, 10, recent_days=7, as_of=as_of)
    assert {r.page_id for r in items.collect()} == {1, 3}          # day 7 edge inclusive
    unsafe = spark.createDataFrame([(3,)], "page_id long")
    items, _ = web_search(q, pages, 10, recent_days=7, as_of=as_of, unsafe=unsafe)
    assert {r.page_id for r in items.collect()} == {1}
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in safe_rows(docs, labels).collect()] == [2]


def test_results_text_fields(spark):
    items = spark.createDataFrame([(1, 1, None, " https://u/1 ", "line\nbreak "), (1, 2, "B", "https://u/2", "s")],
                                  "query_id long, rank int, title string, link string, snippet string")
    from tessera.functions.text import clean_field
    items = items.select("query_id", "rank", clean_field(F.col("title")).alias("title"),
                         clean_field(F.col("link")).alias("link"),
                         clean_field(F.col("snippet"), newline_to_space=True).alias("snippet"))
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    t = {r.query_id: r.results_text for r in results_text(q, items).collect()}
    assert t[1] == "1. \nhttps://u/1\nline break\n\n2. B\nhttps://u/2\ns"
    assert t[2] == NO_RESULTS


def test_fetch_pages_bundle(spark):
    res = spark.createDataFrame([(1, "see https://a.example.com/x, and (https://missing.example.com/q)."),
                                 (2, "none")], "query_id long, results_text string")
    out = {r.query_id: r for r in fetch_pages(res, _pages(spark), 3).collect()}
    assert out[1].bundle == ("\n\n[URL] https://a.example.com/x\n\nT\nalpha beta gamma"
                             + "\n\n" + "-" * 40 + "\n\n"
                             + "[https://missing.example.com/q] HTTP 404 - unable to fetch.")
    assert out[2].bundle == "No URLs found in the provided search results text."


def test_bm25_numpy_equals_join(spark):
    from tessera.operators.web import bm25, page_index, split_site_query
    from conftest import SF001
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    idx = page_index(pages)
    q = spark.read.parquet(f"{SF001}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    q = q.withColumn("text", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("site:example.com "), "text"))
                     .otherwise(F.col("text")))
    q = q.select("query_id", *split_site_query(F.col("text")))
    kw = dict(query_text="_q", doc_id="page_id", doc_text="text", doc_tc="_tc", site_cols=("_site", "_host"))
    a = {tuple(r) for r in bm25(q, idx, 10, method="auto", **kw).collect()}
    b = {tuple(r) for r in bm25(q, idx, 10, method="join", **kw).collect()}
    assert a == b and len(a) > 100


def test_fallback_tiers(spark):
    from tessera.operators.web import fallback
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, "c1", 0.9), (1, 2, "c2", 0.2), (2, 1, "c3", 0.3)],
                                 "query_id long, rank int, chunk_id string, score double")
    web = spark.createDataFrame([(2, 1, "https://w/2", 1.5), (3, 1, "https://w/3", 2.0),
                                 (1, 1, "https://w/1", 9.0)],
                                "query_id long, rank int, link string, score double")
    got = sorted(tuple(r) for r in fallback(q, hits, web, 0.5).collect())
    assert got == [(1, "internal", 1, "c1", 0.9), (1, "internal", 2, "c2", 0.2),
                   (2, "web", 1, "https://w/2", 1.5), (3, "web", 1, "https://w/3", 2.0)]
