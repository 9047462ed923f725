import random

from pyspark.sql import functions as F

from tessera.functions.html import extract_urls, page_text
from tessera.functions.ids import uuid5_column, namespace_hex, chunk_key
from tessera.functions.text import clean_text, WHITESPACE_CODEPOINTS
from tessera.operators.chunking import chunk_table

import restate as R
from conftest import SF001

SPECIAL = [chr(c) for c in WHITESPACE_CODEPOINTS] + ["a", "b", "é", "😀", "x y", "​"]


def _random_texts(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.choice([0, 1, 5, 50, 999, 1000, 1001, 1900, 1901, 2500])
        out.append("".join(rnd.choice(SPECIAL + list("abcdefgh ")) for _ in range(k)))
    return out


def test_clean_text_matches_python_split(spark):
    texts = _random_texts(200)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text(F.col("t")).alias("c")).collect()}
    assert all(got[i] == R.clean_text(t) for i, t in enumerate(texts))


def test_chunks_match_restatement(spark):
    texts = _random_texts(120) + ["😀" * 1950, "a" * 1000, "b" * 1001]
    rows = [(f"u{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "uri string, text string")
    for chunk, overlap in [(1000, 100), (50, 0), (10, 10), (10, 25)]:
        got = {}
        for r in chunk_table(df, "uri", "text", "gs://t/", chunk, overlap).collect():
            got.setdefault(r.source, []).append((r.chunk_index, r.text, r.chunk_id))
        for uri, t in rows:
            want = R.chunk_text(t, chunk, overlap)
            have = sorted(got.get(uri, []))
            assert [x[1] for x in have] == want, (uri, chunk, overlap)
            assert [x[2] for x in have] == [R.chunk_id("gs://t/", uri, i) for i in range(len(want))]


def test_chunking_rejects_bad_geometry():
    import pytest
    from tessera.functions.text import validate_chunking
    with pytest.raises(ValueError):
        validate_chunking(0, 0)
    with pytest.raises(ValueError):
        validate_chunking(10, -1)


def test_uuid5_matches_python(spark):
    df = spark.createDataFrame([("gs://b/ä/x.txt", i) for i in range(50)], "uri string, i int")
    ns = namespace_hex("gs://b/")
    out = uuid5_column(df, ns, chunk_key(F.col("uri"), F.col("i")), "id").collect()
    assert all(r.id == R.chunk_id("gs://b/", r.uri, r.i) for r in out)


def test_extract_urls_matches_restatement(spark):
    texts = [
        "see https://a.example.com/x). and (https://b.example.com/y), again https://a.example.com/x",
        "no links here",
        "1. T\nhttp://h.example.net/p?q=1&r=2#f\nsnip\n\n2. U\nhttps://k.example.org/a>'\"",
        "x https://z.example.com/]] https://y.example.com/. https://w.example.com/",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for lim in (1, 2, 3, 10):
        got = {r.i: r.u for r in df.select("i", extract_urls(F.col("t"), lim).alias("u")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == R.extract_urls(t, max(lim, 1))


HTML_CASES = [
    "<html><body><form><input>secret</form><noscript>ns</noscript><p>kept</p></body></html>",
    "<footer><nav><a>x</a></nav>foot</footer><div>main &amp; more &copy;</div>",
    "",
    "<html><head><title>T &middot; U</title></head><body>  \n\n\n <p>a</p>\t \n<b>b</body></html>",
    "<!DOCTYPE html><!-- c --><p>" + "word " * 2000 + "</p>",
    "<script>var t=\"</p>\";</script><style>p{}</style>text<br/>more",
]


def test_page_text_matches_parser(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()] + HTML_CASES
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, h string")
    got = {r.i: r.t for r in df.select("i", page_text(F.col("h")).alias("t")).collect()}
    bad = [i for i, h in enumerate(pages) if got[i] != R.page_text(h)]
    assert not bad, bad[:5]


def test_page_output_rules(spark):
    from tessera.functions.html import page_output
    df = spark.createDataFrame([("u1", None), ("u2", ""), ("u3", "x" * 8001), ("u4", "ok")],
                               "url string, t string")
    got = {r.url: r.o for r in df.select("url", page_output(F.col("url"), F.col("t")).alias("o")).collect()}
    assert got["u1"] == "[u1] HTTP 404 - unable to fetch."
    assert got["u2"] == "[u2] Empty page or unreadable content."
    assert got["u3"] == "[URL] u3\n\n" + "x" * 8000 + "\n\n[...truncated...]"
    assert got["u4"] == "[URL] u4\n\nok"
