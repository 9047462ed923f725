from pyspark.sql import functions as F

from tessera.operators.chunking import corpus_chunks
from tessera.operators.retrieval import NO_DOCUMENTS, context, retrieve, retrieve_datapoints
from tessera.operators.upsert import datapoints
from tessera.functions.embed import dense_vector, with_sparse_tf
from tessera.functions.text import clean_text

from conftest import SF01


def test_chunk_ids_unique_stable_and_rebuild_text(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    a = corpus_chunks(docs).select("chunk_id", "source", "chunk_index", "text")
    b = corpus_chunks(docs).select("chunk_id", "source", "chunk_index")
    ra = a.collect()
    assert len({r.chunk_id for r in ra}) == len(ra)
    assert sorted((r.chunk_id, r.source, r.chunk_index) for r in ra) == sorted(tuple(r) for r in b.collect())
    assert all(len(r.text) <= 1000 for r in ra)
    # overlap removed, the chunks rebuild the cleaned text
    by = {}
    for r in ra:
        by.setdefault(r.source, []).append((r.chunk_index, r.text))
    cleaned = {r.uri: r.c for r in docs.select(
        F.concat(F.lit("gs://corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("uri"), clean_text(F.col("text")).alias("c")).collect()}
    for uri, parts in by.items():
        parts.sort()
        text = parts[0][1]
        for i, (_, t) in enumerate(parts[1:], 1):
            start = i * 900
            text = text[:start] + t
        assert text == cleaned[uri]


def test_context_golden(spark):
    chunks = spark.createDataFrame(
        [("c1", "gs://b/a.txt", 0, "red apples and green apples"),
         ("c2", "gs://b/a.txt", 1, "green pears"),
         ("c3", "gs://b/z.txt", 0, "blue sky")], "chunk_id string, source string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "green apples"), (2, "nothing shared")], "query_id long, text string")
    hits = retrieve(q, chunks, 5)
    out = {r.query_id: r for r in context(q, hits).collect()}
    assert out[1].context == "red apples and green apples\n\ngreen pears"
    assert out[1].sources == "gs://b/a.txt#0\ngs://b/a.txt#1" and out[1].hits == 2
    assert (out[2].context, out[2].hits, out[2].sources) == (NO_DOCUMENTS, 0, "")


def test_retrieve_datapoints_content(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", "beta gamma")], "chunk_id string, text string")
    v = with_sparse_tf(chunks, "text", 64)
    v = v.withColumn("feature_vector", dense_vector(F.col("buckets"), F.col("tfs"), F.col("ss"), 64))
    dps = datapoints(v)
    q = v.where("chunk_id = 'c1'").select(F.lit(1).alias("query_id"), "feature_vector")
    got = [(r.datapoint_id, r.content) for r in retrieve_datapoints(q, dps, 5).orderBy("rank").collect()]
    assert got == [("c1", "alpha beta"), ("c2", "beta gamma")]


def test_retrieve_reuses_stored_vectors(spark):
    chunks = spark.createDataFrame(
        [("c1", "s", 0, "red apples"), ("c2", "s", 1, "green pears")],
        "chunk_id string, source string, chunk_index int, text string")
    stored = with_sparse_tf(chunks, "text")
    q = spark.createDataFrame([(1, "apples")], "query_id long, text string")
    a = [tuple(r) for r in retrieve(q, chunks, 5).collect()]
    b = [tuple(r) for r in retrieve(q, stored, 5).collect()]
    assert a == b and a[0][2] == "c1"


def _odd_documents(spark):
    rows = [(k, "web", f"alpha{k % 3} beta{k} gamma. " * (k % 9) + "　 x \ny") for k in range(60)]
    rows += [(5, "web", "alpha1 again"), (7, None, "alpha1 beta7"), (61, "web", None), (62, "web", "É é ÉÉ 12 ²"),
             (63, "web", "alpha2 " * 900), (63, "web", "alpha2 " * 900)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_texts_come_from_the_sources_hit_only(spark):
    docs = _odd_documents(spark)
    q = spark.createDataFrame([(1, "alpha1 beta7"), (2, "É 12"), (3, "alpha2"), (4, None), (5, "nothing here")],
                              "query_id long, text string")
    asked = []

    def chunks_of(sources):
        asked.append(sources.count())
        return corpus_chunks(docs, sources=sources)
    want = retrieve(q, corpus_chunks(docs), 4).collect()
    got = retrieve(q, corpus_chunks(docs), 4, chunks_of=chunks_of).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    assert 0 < asked[0] < 15


def test_counts_hashed_in_tasks_equal_the_columns(spark):
    docs = _odd_documents(spark)
    q = spark.createDataFrame([(1, "alpha1 beta7 é"), (2, "alpha2 ²")], "query_id long, text string")
    stored = with_sparse_tf(corpus_chunks(docs), "text")
    want = sorted(map(str, retrieve(q, stored, 5).collect()))
    assert sorted(map(str, retrieve(q, corpus_chunks(docs), 5).collect())) == want
    import pyarrow as pa
    from tessera.functions.embed import hashed_counts, tokens
    rows = stored.select(tokens(F.col("text")).alias("t"), "buckets", "tfs", "ss").collect()
    b, t, s = hashed_counts(pa.array([r.t for r in rows] + [None, []], pa.list_(pa.string())), 768)
    assert b.to_pylist() == [r.buckets for r in rows] + [[], []]
    assert t.to_pylist() == [r.tfs for r in rows] + [[], []] and s.to_pylist() == [r.ss for r in rows] + [0, 0]
