"""K2-treap search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import queries, treap

from .conftest import ODD, odd_docs

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, words(t)) for i, t in docs]
    n = sum(1 for _, w in held if w)
    total = sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        terms = Counter(words(text))
        rows = []
        for i, w in held:
            tf, score = Counter(w), 0
            for t, c in terms.items():
                if tf[t]:
                    m = 100 - 25 + (25 * len(w) * n) // total
                    score += c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (
                        (10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        rows.sort(key=lambda r: r[:3])
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(rows[:k])]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for k in range(n)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)]             # ties beyond k
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for k in range(25)]
    items += [(100, docs[5][1]), (101, "unseen"), (102, None), (103, ""), (100, "w1 w1 w2"),
              (None, "W2, w3;w3")]
    return docs, items


def frames(spark, docs, items):
    return odd_docs(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block,cells,breadth,slots,batch", [
    (1 << 12, 1 << 21, 64, 1 << 10, 1 << 11), (16, 1 << 21, 1, 3, 4), (1 << 12, 50, 2, 20, 7)])
def test_against_brute_force(spark, monkeypatch, block, cells, breadth, slots, batch):
    monkeypatch.setattr(treap, "BLOCK_DOCS", block)
    monkeypatch.setattr(treap, "BLOCK_CELLS", cells)
    monkeypatch.setattr(treap, "BREADTH", breadth)
    monkeypatch.setattr(treap, "SLOTS", slots)
    monkeypatch.setattr(treap, "ITEMS", batch)
    docs, items = corpus(200, 3)
    d, i = frames(spark, docs, items)
    assert rows_of(treap.rank(d, i)) == sorted(brute(docs, items), key=repr)


def test_odd_rows(spark):
    items = [(1, "tie text here"), (2, "LOREM ipsum word"), (3, "Ünïcödé 中文 🙂"), (4, " \t"), (5, "id")]
    docs = ODD + [(20, "tie tie\x7ftext"), (20, "tie tie\x7ftext")]
    d, i = frames(spark, docs, items)
    assert rows_of(treap.rank(d, i)) == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark):
    d, i = frames(spark, *corpus(10, 1))
    assert treap.rank(d.limit(0), i).collect() == []
    assert treap.rank(d, i.limit(0)).collect() == []
    assert treap.rank(d.where("doc_id < 0 or text = ''"), i).collect() == []


@pytest.mark.parametrize("chunk", [3, 7, 64, 1 << 20])
def test_pieces_of_texts_do_not_cut_terms(monkeypatch, chunk):
    monkeypatch.setattr(treap, "CHUNK", chunk)
    texts = ["alpha beta", "", None, "gammadelta", "epsilon-zeta eta", "x", "ünï cödé", "  "]
    col = pa.array(texts, pa.string())
    got = [[] for _ in texts]
    for row, h in treap.terms(col):
        for r, x in zip(row.tolist(), h.tolist()):
            got[r].append(x)
    monkeypatch.setattr(treap, "CHUNK", 1 << 20)
    name = {t: h for t in {w for t in texts for w in words(t)}
            for _, hs in treap.terms(pa.array([t])) for h in hs.tolist()}
    assert got == [[name[w] for w in words(t)] for t in texts]


def test_totals(spark, monkeypatch):
    docs, _ = corpus(100, 6)
    want = [len(words(t)) for _, t in docs]
    assert treap.totals(odd_docs(spark, docs)) == (sum(1 for w in want if w), sum(want))


@pytest.mark.parametrize("rows,columns,cells", [(1, 1, 1), (5, 3, 9), (900, 70, 4000), (40, 4096, 3000)])
def test_tree_keeps_cells_and_maxima(rows, columns, cells):
    rng = np.random.default_rng(rows)
    at = np.unique(rng.integers(0, rows * columns, cells))
    row, column = at // columns, at % columns
    value = rng.integers(1, 10 ** 6, len(at))
    height = max(1, (max(rows, columns) - 1).bit_length())
    tree = treap.Tree(treap.build(row, column, value, height), height)
    level, first = [(0, 0, 0)], 0                       # node, row, column
    for depth in range(height):
        nxt = []
        for node, r, c in level:
            inside = (row >> (height - depth) == r) & (column >> (height - depth) == c)
            assert tree.top[node] == value[inside].max()
            child = tree.base[node]
            for q in range(4):
                if tree.mask[node] >> q & 1:
                    nxt.append((child, r * 2 + (q >> 1), c * 2 + (q & 1)))
                    child += 1
        level = nxt
    assert {(r, c): tree.top[n] for n, r, c in level} == dict(zip(zip(row.tolist(), column.tolist()), value.tolist()))


def test_pruning_opens_a_part_of_the_grid():
    """A rare pair of terms is found without opening every range."""
    rng = np.random.default_rng(1)
    n = 4096
    impact = rng.integers(1, 1000, n)
    row = np.concatenate([np.zeros(n, np.int64), np.ones(2, np.int64)])
    column = np.concatenate([np.arange(n), [7, 3000]])
    tree = treap.Tree(treap.build(row, column, np.concatenate([impact, [10 ** 6, 10 ** 6]]), 12), 12)
    opened = []

    class Seen(treap.Best):
        def may_enter(self, item, *rest):
            opened.append(len(item))
            return super().may_enter(item, *rest)
    best = Seen(1, 2)
    treap.descend(tree, np.zeros(2, np.int64), np.arange(2), np.array([1, 50]),
                  np.arange(n), np.zeros(n, bool), best)
    assert sorted(best.id.tolist()) == [7, 3000] and sum(opened) < 2 * n


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()]
                   for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(queries.QUERIES["op13_treap"](spark, sf)) == sorted(brute(docs, items), key=repr)
