from pyspark.sql import functions as F

from tessera.operators.retrieval import NO_DOCUMENTS, context, retrieve
from tessera.operators.web import NO_RESULTS, web_search
from tessera.operators.governance import assemble_turns
from tessera.operators.sessions import activity_sessions

CHUNKS = "chunk_id string, source string, chunk_index int, text string"


def test_retrieval_edges(spark):
    chunks = spark.createDataFrame([("c1", "s", 0, "alpha beta")], CHUNKS)
    q = spark.createDataFrame([(1, "!!! ..."), (2, "")], "query_id long, text string")   # no tokens
    out = {r.query_id: r.context for r in context(q, retrieve(q, chunks, 5)).collect()}
    assert out == {1: NO_DOCUMENTS, 2: NO_DOCUMENTS}
    empty_q = spark.createDataFrame([], "query_id long, text string")
    assert retrieve(empty_q, chunks, 5).count() == 0
    empty_c = spark.createDataFrame([], CHUNKS)
    q2 = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert retrieve(q2, empty_c, 5).count() == 0


def test_search_and_turn_edges(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/", "<p>alpha</p>")],
                                  "page_id long, url string, html string")
    q = spark.createDataFrame([(1, "zzz")], "query_id long, text string")
    _, texts = web_search(q, pages, 3)
    assert texts.first().results_text == NO_RESULTS
    ev = spark.createDataFrame([], "invocation_id string, seq long, hook string, text string")
    assert assemble_turns(ev).count() == 0
    e = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string")
    assert activity_sessions(e).count() == 0
