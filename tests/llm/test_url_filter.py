import duckdb
from collections import Counter

from tessera.llm import queries, url_filter

RULES = queries.URL_RULES + [("a.example.net", "/en", "block"), ("Deep.Example.COM", None, "block"),
                             ("org", "/fr/", "block"), (None, "/", "block"), ("x.org", "/fr/", None)]
URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://a.b.net?q=/",
        "HTTP://WWW.EXAMPLE.NET/en/x", "http://example.net/en", "http://example.net/EN/",
        "http://notexample.net/en/", "http://example.com/de/1", "https://a.example.net/english",
        "https://a.example.net/en/", "http://x.org/fr/", "http://org/fr/a/b#/c", "x://é.org/fr/ü",
        "http://deep.example.com", "http://q.deep.example.com/any?x", "a://b://net/",
        "http://u@net:80/", "http://a..net/", "http://.net/", "http://" + "a." * 3000 + "net/" + "b/" * 3000,
        "http://net/" + "z" * 10000, "http://net/\nline"]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([k for c in "?#" if (k := path.find(c)) >= 0], default=len(path))]
    best = []
    for h, p, v in rules:
        if h is None or v is None:
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p) and url and "://" in url:
            best.append((-len(h + p), -len(h), v != "block", h + p, v))
    rule, verdict = min(best)[3:] if best else (None, "allow")
    return host, path, rule, verdict


def test_rules_against_brute_force(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(None, URLS[5], "dup"), (5, URLS[5], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.url_filter(pages, rules).collect()
    assert Counter(map(tuple, got)) == Counter((i, *judged(u, RULES)) for i, u, _ in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.url_filter(pages, rules).collect()] == \
        [(1, "net", "/", None, "allow")]
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_native_plan(spark):
    df = queries.QUERIES["op4_url_filter"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_sql_on_the_driver_tables(spark):
    from tests.oracle_compare import compare, duck
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    assert isinstance(con, duckdb.DuckDBPyConnection)
    for name in queries.ORACLE:
        res = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], sf)
        assert res["status"] == "ok", res
