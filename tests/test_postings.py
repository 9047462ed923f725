"""BM25 over blocks of postings: equal to brute force, unread postings."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from tessera.operators import grid, postings
from tessera.operators.web import bm25


def _corpus(n=150, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.8))}" for _ in range(200)]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 30))), f"{'a.' * (k % 2)}site{k % 3}.org")
            for k in range(n)]
    docs += [(n + k, docs[3][1], "site0.org") for k in range(40)]        # a group of copies
    queries = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 9))), None) for k in range(20)]
    queries += [(30, docs[3][1], None), (31, docs[3][1], "site1.org"), (32, "unseen", None),
                (33, "", None), (34, None, None)]
    return docs, queries


def _brute(docs, queries, k, k1=1.2, b=0.75):
    held = [(i, Counter((t or "").split()), h) for i, t, h in docs]
    n = len(held)
    avgdl = sum(sum(c.values()) for _, c, _ in held) / n
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text, site in queries:
        rows = []
        for i, c, h in held:
            if site and h != site and not h.endswith("." + site):
                continue
            dl = sum(c.values())
            s = sum(math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * c[t] * (k1 + 1)
                    / (c[t] + k1 * (1 - b + b * dl / avgdl)) for t in dict.fromkeys((text or "").split()) if c[t])
            if s > 0:
                rows.append((-round(s, 6), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def _frames(spark, docs, queries):
    return (spark.createDataFrame(docs, "doc_id long, text string, h string").repartition(3),
            spark.createDataFrame(queries, "query_id long, text string, s string"))


@pytest.mark.parametrize("rows,q_rows,entries", [(512, 1024, 1 << 21), (9, 4, 30), (1, 1, 1)])
def test_blocks_of_any_size_equal_brute_force(spark, monkeypatch, rows, q_rows, entries):
    monkeypatch.setattr(postings, "DOC_ROWS", rows)
    monkeypatch.setattr(postings, "QUERY_ROWS", q_rows)
    monkeypatch.setattr(postings, "ENTRIES", entries)
    docs, queries = _corpus(150 if rows > 1 else 20)
    d, q = _frames(spark, docs, queries)
    got = bm25(q, d, 6, query_keep=("s",), doc_keep=("h",), site_cols=("s", "h")).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == _brute(docs, queries, 6)


def test_blocks_that_cannot_enter_stay_unread():
    """After the block with the rare term, blocks with only the common one are
    skipped; results are those of reading all."""
    docs = [("common " * 3 + "rare" if k < 8 else "common" + " pad" * 8) for k in range(400)]
    rows = [(k, *zip(*Counter(t.split()).items())) for k, t in enumerate(docs)]

    def block(part):
        return postings.index_block(pa.RecordBatch.from_pydict(
            {"id": [r[0] for r in part], "host": pa.array([None] * len(part), pa.string()),
             "dl": [sum(r[2]) for r in part], "terms": [list(r[1]) for r in part],
             "tfs": [list(r[2]) for r in part]}))
    query = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([None], pa.string()),
         pa.array([[{"term": "common", "idf": 0.1}, {"term": "rare", "idf": 3.0}]]), pa.array([8.5])],
        ["id", "site", "terms", "avgdl"])
    s = postings.Scorer(query, 3, 1.2, 0.75, 1e-6, ["q", "d", "s"])
    blocks = [block(rows[lo:lo + 50]) for lo in range(0, 400, 50)]
    stored = sum(len(b.column("doc")[0]) for b in blocks)
    for b in blocks:
        s.meet(b)
    got, = s.rows()
    assert got.column("d").to_pylist() == [0, 1, 2]
    assert s.read == 58 and stored == 800


def test_empty_corpus_and_queries(spark):
    d, q = _frames(spark, *_corpus(5))
    assert bm25(q, d.limit(0), 3).count() == 0 and bm25(q.limit(0), d, 3).count() == 0
    assert bm25(q, d.where("text = ''"), 3).count() == 0


def test_plan_collects_and_broadcasts_nothing_by_hand(spark):
    from tessera.functions.embed import term_counts, tokens
    from pyspark.sql import functions as F
    d, q = _frames(spark, *_corpus(30))
    idx = d.withColumn("_tc", term_counts(tokens(F.col("text"))))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bm25-plan", "")
    try:
        top = bm25(q, idx, 3, doc_tc="_tc")
        assert not jobs.getJobIdsForGroup("bm25-plan")       # planning runs no job
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(cell") == 2 and "NestedLoop" not in plan
