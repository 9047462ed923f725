"""The grid of blocks: every pair once, bounded blocks, ties, skipped pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import grid as G
from tessera.operators import knn
from tessera.operators.knn import topk_dense, topk_sparse


def test_keys_fall_into_different_partitions(spark):
    values = list(range(50)) + [2 ** 31 - 1]
    got = spark.createDataFrame([(v,) for v in values], "v int").select(F.hash("v")).collect()
    assert [r[0] for r in got] == [G.spark_hash(v) for v in values]
    keys = G.cell_keys(24)
    parts = spark.createDataFrame([(k,) for k in keys], "v int").repartition(24, "v") \
        .select(F.spark_partition_id()).distinct().count()
    assert parts == 24


def test_blocks_are_bounded_and_lose_no_row(monkeypatch):
    monkeypatch.setattr(G, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(0)
    batches = [pa.RecordBatch.from_pydict({"x": ["y" * int(n) for n in rng.integers(0, 900, size)]})
               for size in (1, 40, 0, 7, 100)]
    batches.append(pa.RecordBatch.from_pydict({"x": ["z" * 9000]}))
    got = list(G.row_groups(iter(batches), 16))
    assert [x for g in got for x in g.column("x").to_pylist()] == \
        [x for b in batches for x in b.column("x").to_pylist()]
    assert all(g.num_rows <= 16 for g in got)
    assert all(g.num_rows == 1 or sum(map(len, g.column("x").to_pylist())) <= 4000 for g in got)


def _vectors(spark, n, dim=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    if copies:
        v[-copies:] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)] + [(n + 5, None)]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def _brute(v, w, k, exclude=False):
    out = []
    for i, x in enumerate(v):
        s = np.round(w.astype(float) @ x.astype(float), 6)
        order = sorted((j for j in range(len(w)) if not (exclude and i == j)), key=lambda j: (-s[j], j))[:k]
        out += [(i, j, r + 1) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("q_rows,c_rows", [(1024, 512), (7, 11), (1, 1)])
def test_many_blocks_on_both_sides(spark, monkeypatch, q_rows, c_rows):
    """A query side larger than one block, with a hot group of equal vectors."""
    monkeypatch.setattr(knn, "QUERY_ROWS", q_rows)
    monkeypatch.setattr(knn, "CANDIDATE_ROWS", c_rows)
    monkeypatch.setattr(G, "SLACK", 20)
    n = 120 if q_rows > 1 else 30
    v, e = _vectors(spark, n, copies=n // 3)
    got = topk_dense(e.repartition(3).withColumnRenamed("vec_id", "query_id"), e.repartition(2), 4,
                     exclude_self=True)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == _brute(v, v, 4, True)


def test_ties_do_not_pile_up():
    best = G.Running(2, 3)
    for lo in range(0, 30_000, 500):
        best.offer(np.ones((500, 2)), pa.array(range(lo, lo + 500)), np.arange(2))
    assert best.size <= 2 * best.kept + G.SLACK + 1000
    got, = best.rows(pa.array(["a", "b"]), ["q", "c", "s"])
    assert got.column("c").to_pylist() == [0, 1, 2] * 2


def test_far_blocks_are_skipped(spark, monkeypatch):
    """With vectors of shrinking length only the first blocks are scored in full."""
    monkeypatch.setattr(knn, "CANDIDATE_ROWS", 50)
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1000, 8)) * (np.arange(1000) < 50)[:, None] + 1e-3 * rng.normal(size=(1000, 8))
    c = spark.createDataFrame([(i, [float(x) for x in w[i]]) for i in range(1000)],
                              "vec_id long, embedding array<double>").coalesce(1)
    q = c.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    seen = spark.sparkContext.accumulator(0)
    offer = G.Running.offer

    def counted(self, scores, ids, which):
        seen.add(scores.size)
        offer(self, scores, ids, which)
    # the worker unpickles grid.Running by reference: count through a subclass
    class Counted(G.Running):
        offer = counted
    monkeypatch.setattr(knn, "Running", Counted)
    monkeypatch.setattr(knn, "grid", lambda *a: G.grid(*a, cells=1))
    got = topk_dense(q, c, 3)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == _brute(w[:20], w, 3)
    assert seen.value < 0.5 * 20 * 1000


def test_empty_sides(spark):
    _, e = _vectors(spark, 5)
    q = e.withColumnRenamed("vec_id", "query_id")
    assert topk_dense(q.limit(0), e, 3).count() == 0 and topk_dense(q, e.limit(0), 3).count() == 0
    sparse = spark.createDataFrame([], "query_id long, buckets array<int>, tfs array<int>, ss long")
    assert topk_sparse(sparse, sparse.withColumnRenamed("query_id", "chunk_id"), 3, 16).count() == 0


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    """Beyond the first slice only pairs that can still reach the k best."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 16))
    seen = []
    offer, add = G.Running.offer, G.Running.add
    monkeypatch.setattr(G.Running, "offer", lambda self, s, *a: (seen.append(s.size), offer(self, s, *a))[1])
    monkeypatch.setattr(G.Running, "add", lambda self, s, *a: (seen.append(len(s)), add(self, s, *a))[1])
    top = knn.DenseTopK(v[:100], pa.array(range(100)), 3, 1e-6, True)
    for lo in range(0, 4000, 1000):
        top.score(v[lo:lo + 1000], pa.array(range(lo, lo + 1000)), np.arange(100))
    got, = top.rows(["q", "c", "s"])
    best = {(q, c) for q, c, _ in _brute(v[:100], v, 3, True)}
    assert best <= set(zip(got.column("q").to_pylist(), got.column("c").to_pylist()))
    assert sum(seen) < 0.2 * 100 * 4000


@pytest.mark.parametrize("cells", [1, 3, 12])
def test_square_grid_meets_each_pair_once(spark, cells):
    """Two axes: every pair once, few states of a query block."""
    def numbers(block):
        return block.column("id").to_pylist()

    class State:
        def __init__(self, block):
            self.mine, self.met = numbers(block), []

        def meet(self, block):
            self.met += numbers(block)

        def rows(self):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((a, b) for a in self.mine for b in self.met))],
                                             ["q", "c"])
            yield pa.RecordBatch.from_arrays([pa.array(self.mine), pa.array([-1] * len(self.mine))], ["q", "c"])
    q, c = spark.range(40).repartition(3), spark.range(60).repartition(2)
    got = G.grid(G.packed(q, 4), G.packed(c, 5), State, T.StructType(
        [T.StructField("q", T.LongType()), T.StructField("c", T.LongType())]), cells=cells, square=True).collect()
    assert sorted((r.q, r.c) for r in got if r.c >= 0) == [(a, b) for a in range(40) for b in range(60)]
    assert sum(r.c < 0 for r in got) <= 40 * max(1, int(cells ** 0.5))
