"""Decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessera.llm import decontam, queries
from tessera.llm.base import staged

from .conftest import odd_docs

SF = "/root/testdata/sf0.01"
_W = re.compile(r"[^\W_]+")


def overlaps(docs, items, n=5):
    """{(doc, item): share of the item's n-grams that the document has}."""
    grams, size = defaultdict(set), {}
    for i, t in items:
        w = _W.findall((t or "").lower())
        g = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
        size[i] = len(g)
        for x in g:
            grams[x].add(i)
    out = {}
    for d, t in docs:
        w = _W.findall((t or "").lower())
        c = Counter(i for x in {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
                    for i in grams.get(x, ()))
        out.update({(d, i): k / size[i] for i, k in c.items()})
    return out


def test_driver_tables_equal_the_shared_passages(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_decontamination"](
        spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    share = overlaps(docs, items)
    assert {k for k, v in share.items() if v >= 0.9} <= got
    assert got <= {k for k, v in share.items() if v >= 0.3}


def _corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab)
                      for _ in range(n)]
    items = [(k, text(rng.choice([16, 25, 50, 120]))) for k in range(20)]
    docs, truth = [], set()
    for d in range(300):
        w = text(rng.choice([20, 200, 900]))
        if d % 5 == 0:
            i, q = items[d // 5 % 20]
            q = list(q)
            if d % 10 == 0:                     # a paraphrase: a sixth of the words changed, not the answer
                for k in rng.sample(range(len(q) - max(len(q) // 4, 2)), len(q) // 6):
                    q[k] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = q
            truth.add((d, i))
        docs.append((d, " ".join(w)))
    return docs, [(i, " ".join(q)) for i, q in items], truth


def test_copies_and_paraphrases_are_found_and_nothing_else(spark):
    docs, items, truth = _corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.hits(odd_docs(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    assert all(r["lcs"] >= 0.75 or r["lcs"] >= 0.6 and r["answer"] >= 0.5 for r in got)


def test_items_in_blocks_and_odd_rows(spark, monkeypatch):
    docs, items, truth = _corpus(2)
    odd = [(1000, None), (1001, ""), (None, items[3][1]), (1002, items[3][1]), (1002, items[3][1]),
           (1003, "x " * 60_000 + items[4][1])]
    bench = spark.createDataFrame(items + [(77, None), (78, "too short"), (3, items[3][1])],
                                  "item_id long, text string").selectExpr("*", "1 AS cosine")
    monkeypatch.setattr(decontam, "ITEMS", 7)
    frame = odd_docs(spark, docs + odd)
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.hits(frame, bench).collect())
    assert set(got) == truth | {(None, 3), (1002, 3), (1003, 4)}
    assert got[None, 3] == 2 and got[1002, 3] == 4          # the item stands there twice
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == \
        {d for d, _ in docs + odd} - {d for d, _ in set(got)}


def test_short_items_and_unspaced_scripts(spark):
    docs, items, truth = _corpus(3)
    han = "\u6c34\u5728\u4e00\u4e2a\u5927\u6c14\u538b\u4e0b\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u6444\u6c0f\u5ea6"
    thai = "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e"
    short = [(50, "Who wrote Faust?"), (51, "zebra"), (52, "seven words of an item stand here"),
             (53, han + "\uff1f"), (54, thai), (55, han[:3]), (56, "?!"), (57, "na\u00efve caf\u00e9")]
    more = [(900, "he asked: who  WROTE\nfaust and left"), (901, "who never wrote faust"),
            (902, "a Zebra, that is"), (903, "zebras"), (904, "so seven words of an item stand here too"),
            (905, "seven words of an item stand"), (906, "\u8bf7\u95ee\uff1a" + han + "\u3002\u7b54"),
            (907, "abc" + thai + "def"), (908, thai[:-1]), (909, "the na\u00efve caf\u00e9s"),
            (910, "the na\u00efve caf\u00e9"), (911, "who wrote"), (912, "faust who wrote faust")]
    bench = spark.createDataFrame(items + short, "item_id long, text string")
    frame = odd_docs(spark, docs + more)
    got = decontam.hits(frame, bench).collect()
    wanted = {(900, 50), (902, 51), (904, 52), (906, 53), (906, 55), (907, 54), (910, 57), (912, 50)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth | wanted
    assert all(r["lcs"] == 1 and r["answer"] == 1 for r in got if r["doc_id"] >= 900)
    only = spark.createDataFrame(short[:2], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.clean(frame, only).collect()} == \
        {d for d, _ in docs + more} - {900, 902, 912}


def test_verbatim_parts_of_long_items(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((1000, 300, 40, 25))]
    cut = lambda k, lo, to: items[k][1][lo:to]
    loose = cut(0, 400, 600)                     # every tenth word of a fifth of the item changed
    loose[::10] = text(20)
    parts = [(cut(0, 0, 700), 0), (cut(0, 500, 1000), 0), (cut(0, 300, 313), 0), (loose, 0),
             (cut(1, 100, 250), 1), (cut(2, 0, 20), 2), (cut(2, 10, 23), 2), (cut(3, 12, 25), 3),
             (cut(0, 300, 312), None), (cut(2, 0, 12), None), (cut(0, 0, 1000)[::-1], None)]
    docs = [(d, " ".join(text(150) + q + text(60))) for d, (q, _) in enumerate(parts)]
    docs += [(100 + d, " ".join(text(200))) for d in range(100)]
    bench = spark.createDataFrame([(k, " ".join(q)) for k, q in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.hits(odd_docs(spark, docs), bench).collect()}
    assert set(got) == {(d, k) for d, (_, k) in enumerate(parts) if k is not None}
    assert 0.69 < got[0, 0]["lcs"] < 0.72 and got[0, 0]["answer"] < 0.1
    assert got[2, 0]["lcs"] == 0.013 and got[7, 3]["lcs"] == 13 / 25
    assert got[3, 0]["lcs"] < 0.25 and got[3, 0]["cosine"] is not None


def test_words_of_unspaced_scripts():
    texts = ["ab\u4e2d\u6587cd \u00e9\u00e8 x\u3002y", None, "", "\U00020000\U00020001z \ud55c\uad6d", "\u0e01\u0e23"]
    w = decontam.ItemWords(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b])]
           for a, b in zip(w.first, w.first[1:])]
    assert got == [["ab", "\u4e2d", "\u6587", "cd", "\u00e9\u00e8", "x", "y"], [], [],
                   ["\U00020000", "\U00020001", "z", "\ud55c\uad6d"], ["\u0e01", "\u0e23"]]


def test_empty_tables(spark):
    docs, items, _ = _corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = odd_docs(spark, docs[:20])
    assert decontam.hits(frame.limit(0), bench).count() == 0
    assert decontam.hits(frame, bench.limit(0)).count() == 0
    assert decontam.clean(frame, bench.limit(0)).count() == 20


def test_pipeline_stages(spark):
    """Each stage on all its predecessor kept, against a plain restatement."""
    from tests.llm.test_dedup import SPACE, near_truth
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in out.collect()}
        assert left.items() <= rows.items() and len(left) == out.count()
        gone = set(rows) - set(left)
        if name == "toxicity":
            known = [i for i in rows if i in toxic]
            assert sum((i in gone) == (toxic[i] == 1) for i in known) > 0.97 * len(known)
            assert len(gone) < 0.15 * len(rows)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(rows):
                first.setdefault(SPACE.sub(" ", rows[i] or ""), i)
            assert set(left) == set(first.values())
        elif name == "near_dedup":
            truth = near_truth(sorted(rows.items()), 5, 80, 100)
            assert set(left) == {i for i, _, _, kept in truth if kept}
        else:
            share = overlaps(rows.items(), items)
            assert {d for (d, _), v in share.items() if v >= 0.9} <= gone
            assert gone <= {d for (d, _), v in share.items() if v >= 0.3}
        docs, rows = out, left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    by_doc = {r["doc_id"]: r for r in pieces.groupBy("doc_id").agg(
        {"length": "sum", "doc_tokens": "max"}).collect()}
    assert set(by_doc) == set(rows)
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in by_doc.values())


def _plain_length(q, text):
    best = [0] * (len(text) + 1)
    for a in q:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(row[-1], best[j + 1], best[j] + (a == b)))
        best = row
    return best[-1]


def test_alignment_by_halves_is_a_longest_common_subsequence(monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(60):
        q, text = (rng.integers(0, 9, rng.integers(0, 50)).astype(np.uint64) for _ in range(2))
        whole = decontam._aligned(q, text)
        with monkeypatch.context() as m:
            m.setattr(decontam, "CELLS", 20)
            halves = decontam._aligned(q, text)
        for at in (whole, halves):
            assert len(at) == _plain_length(q, text) and (np.diff(at) > 0).all()
            left = iter(text.tolist())
            assert all(w in left for w in q[at].tolist())         # in this order


def test_alignment_memory_of_a_very_long_item():
    import tracemalloc
    rng = np.random.default_rng(1)
    q = rng.integers(0, 5000, 6000).astype(np.uint64)
    text = np.delete(q, rng.choice(6000, 600, replace=False))
    tracemalloc.start()
    at = decontam._aligned(q, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) >= len(text) * 0.99 and peak < 60 << 20       # a whole table: 140 MB


def test_items_in_many_blocks_with_text_ids(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 3)
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(20))) for k in range(8)]
    docs = spark.createDataFrame([(k, f"some words before {t} and after") for k, (_, t) in enumerate(items)]
                                 + [(100, "a clean text of other words altogether"), (None, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame(items + [(None, None)], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.hits(docs, bench).collect()}
    assert got == {(k, f"i{k}") for k in range(8)}
    left = decontam.clean(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in left) == ["100", "None"]
