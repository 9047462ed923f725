import datetime as dt
import json
import os

from pyspark.sql import functions as F

from tessera.operators.governance import write_log, log_rows
from tessera.operators.ingest import run_ingest, texts_from_files
from tessera.operators.sessions import report_text
from tessera.sources.files import list_files, pages_to_text
from tessera.sources.mapping import load_mapping

import restate as R


def _corpus(root):
    os.makedirs(f"{root}/docs/sub")
    open(f"{root}/docs/a.txt", "w").write("Hello   world\n" * 150)
    open(f"{root}/docs/sub/B.TXT", "wb").write(b"caf\xc3\xa9 \xff bad byte")
    open(f"{root}/docs/empty.txt", "w").write("")
    open(f"{root}/docs/blank.txt", "w").write(" \n\t ")
    open(f"{root}/docs/notes.md", "w").write("not listed")
    open(f"{root}/docs/r.pdf", "wb").write(b"PAGE1|PAGE2")


def test_list_and_read(spark, scratch):
    _corpus(scratch)
    names = sorted(os.path.basename(r.uri) for r in list_files(spark, f"{scratch}/docs").collect())
    # Spark file sources create no split for a zero-byte object, so it is
    # not listed (divergence: it would contribute no chunk either way)
    assert names == ["B.TXT", "a.txt", "blank.txt", "r.pdf"]
    t = {os.path.basename(r.uri): r.text for r in texts_from_files(spark, f"{scratch}/docs").collect()}
    assert t["B.TXT"] == "café  bad byte" and t["r.pdf"] == ""


def test_run_ingest_with_extractor(spark, scratch):
    _corpus(scratch)
    texts = texts_from_files(spark, f"{scratch}/docs",
                             extractor=lambda b: b.decode().split("|"))
    store = f"{scratch}/store"
    s1 = run_ingest(spark, texts, "gs://corpus/", store)
    assert (s1["files_found"], s1["files_without_text"]) == (4, 1)
    m = load_mapping(spark, store)
    a_uri = [r.source for r in m.collect() if r.source.endswith("/a.txt")][0]
    want = R.chunk_text("Hello   world\n" * 150)
    got = [r.text for r in m.where(F.col("source") == a_uri).orderBy("chunk_index").collect()]
    assert got == want
    # pages are joined by a newline, then cleaned like any text before chunking
    assert m.where(F.col("source").endswith("r.pdf")).first().text == "PAGE1 PAGE2"
    # re-ingest: same ids, idempotent
    s2 = run_ingest(spark, texts, "gs://corpus/", store)
    assert load_mapping(spark, store).count() == m.count() == s1["chunks"] == s2["chunks"]
    assert s2["mapping_rows"] == m.count()


def test_pages_to_text_order_and_nulls(spark):
    df = spark.createDataFrame([("u", 2, "c"), ("u", 0, "a"), ("u", 1, None)], "uri string, page_no int, text string")
    assert pages_to_text(df).first().text == "a\n\nc"


def test_write_log(spark, scratch):
    rows = spark.createDataFrame([("Final agent turn", "warn", '{"x": 1}', dt.datetime(2024, 1, 2, 3))],
                                 "message string, severity string, custom string, ts timestamp")
    out = log_rows(rows, keep=("ts",))
    write_log(out, f"{scratch}/log")
    back = spark.read.json(f"{scratch}/log").collect()
    assert back[0].severity == "WARNING" and json.loads(back[0].custom) == {"x": 1}
    assert str(back[0].date) == "2024-01-02"


def test_report_text_next_day_in_jakarta(spark):
    df = spark.createDataFrame([("notes", dt.datetime(2025, 1, 1, 20, 4, 5))], "s string, ts timestamp")
    r = df.select(report_text(F.col("s"), F.col("ts"))).first()[0]
    assert r == ("Summary of your content: notes.\n\nTime of summary: 2025-01-02 03:04:05 WIB+0700 "
                 "\n\nDisclaimer: Information provided is for demonstration purposes only...")


def test_run_ingest_partitioned(spark, scratch):
    from tessera.sources.mapping import load_partitioned
    _corpus(scratch)
    texts = texts_from_files(spark, f"{scratch}/docs")
    store = f"{scratch}/pstore"
    s1 = run_ingest(spark, texts, "gs://corpus/", store, partitioned=True)
    s2 = run_ingest(spark, texts, "gs://corpus/", store, partitioned=True)
    m = load_partitioned(spark, store)
    assert m.count() == s1["chunks"] == s2["chunks"] and s1["partitions_rewritten"] >= 1
