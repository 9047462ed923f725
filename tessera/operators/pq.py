"""Approximate top-k by product-quantised residuals with exact re-ranking.

``train`` fits, on a bounded sample, about sqrt(N) coarse centroids and, per group
of ``SUB`` dimensions, a codebook of up to 256 residual centroids. ``index`` gives
every vector its cell and one code byte per group. ``search`` sends each query to
its ``nprobe`` nearest cells; a candidate's score is estimated without its vector
as ``q . centroid`` plus one entry of the query's distance table per code byte,
which is its product with the vector that the code stands for. The ``rerank`` best
estimates of each query are then scored exactly from the vectors. Centroids and codebooks (bounded by ``MAX_CELLS`` and
256) travel in the task closure. Scores returned are exact; which neighbours are
found is approximate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_dir
from .grid import CANDIDATE_ROWS, QUERY_ROWS, TASKS, grid, packed
from .knn import DenseTopK, _final_topk, _rounding_margin, dense_matrix, probe_cells

SUB = 4                     # dimensions of one code byte
CODES = 256
MAX_CELLS = 4096
SAMPLE = 20_000             # rows the model is fitted on
CUT_BYTES = 256 << 20       # estimates held for a block of queries
HELD = 4                    # of each query so many times those that it keeps
RUN_PAIRS = 1 << 20         # pairs of a cell and its queries scored at once


@dataclass
class Quantizer:
    centroids: np.ndarray   # (cells, dims)
    books: np.ndarray       # (groups, codes, SUB); dims padded with zeros

    def padded(self, x: np.ndarray) -> np.ndarray:
        """(rows, groups, SUB)"""
        groups = len(self.books)
        out = np.zeros((len(x), groups * SUB))
        out[:, :x.shape[1]] = x
        return out.reshape(len(x), groups, SUB)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code bytes) of each vector."""
        cell = nearest(x, self.centroids)
        rest = self.padded(x - self.centroids[cell])
        codes = np.stack([nearest(rest[:, g], b) for g, b in enumerate(self.books)], 1)
        return cell, codes.astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that (cell, codes) stand for: a query's dot product with
        one is ``q . centroid`` plus its table entries."""
        groups, size, _ = self.books.shape
        out = self.books.reshape(groups * size, -1).take(codes + size * np.arange(groups), 0)
        return out.reshape(len(codes), -1)[:, :self.centroids.shape[1]] + self.centroids.take(cell, 0)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, groups, codes): what a code adds to the estimate."""
        return np.einsum("qgs,gcs->qgc", self.padded(q), self.books)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([np.argmin(half - x[i:i + 4096] @ centres.T, 1) for i in range(0, len(x), 4096)]) \
        if len(x) else np.zeros(0, np.int64)


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centres of ``k`` clusters; an empty one takes a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.stack([np.bincount(at, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None],
                           x[rng.integers(0, len(x), len(centres))])
    return centres


def train(candidates: DataFrame, cells: int | None = None, *, cand_id: str = "vec_id",
          vec: str = "embedding", sample: int = SAMPLE) -> Quantizer | None:
    """Fit on the ``sample`` rows with the smallest hash of their id; None if
    there is no vector."""
    rows = candidates.select(cand_id, F.col(vec).alias("v")).where("v IS NOT NULL")
    n = rows.count()
    if not n:
        return None
    some = rows.orderBy(F.xxhash64(cand_id), cand_id).limit(sample).select("v").toPandas()["v"]
    x = np.stack(some.to_numpy()).astype(np.float64)
    cells = cells or int(round(n ** 0.5))
    centroids = lloyd(x, max(1, min(cells, MAX_CELLS, len(x) // 4 or 1)))
    q = Quantizer(centroids, np.zeros((-(-x.shape[1] // SUB), 1, SUB)))
    rest = q.padded(x - centroids[nearest(x, centroids)])
    books = [lloyd(rest[:, g], CODES, seed=g) for g in range(rest.shape[1])]
    return Quantizer(centroids, np.stack(books))


def index(candidates: DataFrame, model: Quantizer, *, cand_id: str = "vec_id",
          vec: str = "embedding") -> DataFrame:
    """(cand_id, cell, codes) of every vector."""
    rows = candidates.select(F.col(cand_id), F.col(vec).alias("v")).where("v IS NOT NULL")
    schema = T.StructType([rows.schema[cand_id], T.StructField("cell", T.IntegerType()),
                           T.StructField("codes", T.BinaryType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1)
                cell, codes = model.encode(x)
                data = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column(cand_id), pa.array(cell, pa.int32()), data.cast(pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def slim(block: pa.RecordBatch) -> pa.RecordBatch:
    """A block to send to many tasks: bytes of equal lengths without offsets, cells
    (``MAX_CELLS`` at most) in two bytes."""
    def column(name: str, col: pa.Array) -> pa.Array:
        if name == "cell":
            return col.cast(pa.uint16())
        if name in ("codes", "probed"):
            col = col.cast(pa.binary())
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
            data = col.buffers()[2][int(off[0]):int(off[-1])]
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(data) // len(col)), len(col), [None, data])
        return col
    names = block.schema.names
    return pa.RecordBatch.from_arrays([column(n, c) for n, c in zip(names, block.columns)], names)


def byte_matrix(col: pa.FixedSizeBinaryArray) -> np.ndarray:
    """(rows, bytes)"""
    n = col.type.byte_width
    return np.frombuffer(col.buffers()[1], np.uint8)[col.offset * n:][:len(col) * n].reshape(len(col), n)


class Reach:
    """Which pairs of candidates (``x``: what their codes stand for) and queries have
    an estimate of at least the query's ``least``."""
    def __init__(self, x: np.ndarray, queries: np.ndarray, least: np.ndarray):
        self.x, self.queries, self.least = x, queries, least

    def __getitem__(self, rows: slice) -> Reach:
        return Reach(self.x[rows], self.queries, self.least)

    def mask(self, which: np.ndarray) -> np.ndarray:
        return self.x @ self.queries[which].T >= self.least[which]

    def pairs(self, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x[row], self.queries[query]) >= self.least[query]


class Places:
    """Where each id stands in a column; null equals nothing."""
    def __init__(self, ids: pa.Array):
        ids, at = self._known(ids)
        order = np.argsort(ids, kind="stable")
        self.ids, self.at = ids[order], at[order]

    @staticmethod
    def _known(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.asarray(ids.is_valid()))
        return ids.take(pa.array(at)).to_numpy(zero_copy_only=False), at

    def of(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``ids``, place) of all equal ids, by row."""
        ids, row = self._known(ids)
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        some = np.flatnonzero(hi > lo)
        n = (hi - lo)[some]
        i = np.repeat(some, n)
        place = np.repeat(lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = ids[i] == self.ids[place]                 # not so for NaN
        return row[i[same]], self.at[place[same]]


def search(queries: DataFrame, candidates: DataFrame, indexed: DataFrame, model: Quantizer, k: int,
           nprobe: int, rerank: int, *, query_id: str = "query_id", cand_id: str = "vec_id",
           vec: str = "embedding", exclude_self: bool = False, rows_per_group: int = 8192,
           queries_per_group: int = 1024, score_digits: int = 6) -> DataFrame:
    """(query_id, cand_id, score, rank): the ``k`` best by exact score among the
    ``rerank`` best estimates of each query (of each query id, if it repeats).

    Neither the probed pairs nor the estimates are written out. A first grid
    meets blocks of queries with all code blocks, in cell order, and gives per
    query the ``rerank``-th best estimate; a second one meets the queries with
    blocks of codes and vectors and ranks the pairs that reach it. The rows of a
    cell follow each other: they meet the queries that probe it, and no mask of
    all pairs is made. Re-ranking scores a cell in single precision first; the
    estimate and the exact score are taken of pairs that can still reach the k
    best. Estimates are single precision: those equal within its rounding stay."""
    spark = queries.sparkSession
    nprobe = max(1, min(nprobe, len(model.centroids)))
    fields = {f.name: f.dataType for f in queries.schema.fields}
    q = probe_cells(queries, model.centroids, nprobe, query_id, vec, maps=True) \
        .select(F.col(query_id).alias("id"), F.col("_qv").alias("v"), F.col("_cells").alias("probed"))
    # some bytes a row, read three times and dear to make
    checkpoint_dir(spark)
    coded = indexed.select(F.col(cand_id).alias("id"), "cell", "codes").checkpoint()
    cells = len(model.centroids)
    single = Quantizer(model.centroids.astype(np.float32), model.books.astype(np.float32))
    # what single precision can change in an estimate of a vector of length 1
    slack = 2.0 ** -22 * (model.centroids.shape[1] + 2) * (
        np.linalg.norm(model.centroids, axis=1).max() + np.sqrt((model.books ** 2).sum(2).max(1).sum()))

    class Estimates:
        def __init__(self, block: pa.RecordBatch):
            self.ids = block.column("id")
            self.matrix = dense_matrix(block.column("v"))
            self.single = self.matrix.astype(np.float32)
            self.slack = slack * np.linalg.norm(self.matrix, axis=1)
            # by cell: the queries that probe it
            self.probed = np.unpackbits(byte_matrix(block.column("probed")), axis=1, count=cells).astype(bool).T.copy()

        def runs(self, block: pa.RecordBatch):
            """What the codes of a block stand for, and (from, to, queries that probe
            it) of its rows of one cell."""
            cell = np.asarray(block.column("cell"))
            ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
            runs, lo = [], 0
            for hi in ends:
                which = np.flatnonzero(self.probed[cell[lo]])
                if len(which):
                    step = max(1, RUN_PAIRS // len(which))
                    runs += [(a, min(a + step, hi), which) for a in range(lo, hi, step)]
                lo = hi
            return single.decode(cell, byte_matrix(block.column("codes"))) if runs else None, runs

    class Cut(Estimates):
        """The ``rerank`` best estimates of each query of a block."""
        def __init__(self, block: pa.RecordBatch):
            super().__init__(block)
            self.places = Places(self.ids) if exclude_self else None
            self.best = np.empty((block.num_rows, held), np.float32)
            self.used = 0

        def meet(self, block: pa.RecordBatch) -> None:
            x, runs = self.runs(block)
            if not runs:
                return
            if self.used + len(x) > self.best.shape[1]:
                self.prune()
            row, own = self.places.of(block.column("id")) if exclude_self else (np.zeros(0, int),) * 2
            for lo, hi, which in runs:
                s = self.best[:, self.used:self.used + hi - lo]
                s[self.missing(which)] = -np.inf
                s[which] = self.single[which] @ x[lo:hi].T
                a, b = np.searchsorted(row, (lo, hi))
                s[own[a:b], row[a:b] - lo] = -np.inf
                self.used += hi - lo

        def missing(self, which: np.ndarray) -> np.ndarray:
            rest = np.ones(len(self.ids), bool)
            rest[which] = False
            return np.flatnonzero(rest)

        def prune(self) -> None:
            if self.used > rerank:
                for lo in range(0, len(self.best), 64):
                    some = self.best[lo:lo + 64, :self.used]
                    some.partition(self.used - rerank, 1)
                    some[:, :rerank] = some[:, -rerank:]
                self.used = rerank

        def rows(self):
            self.prune()
            least = np.full(len(self.ids), -np.inf)
            if self.used >= rerank:
                least = self.best[:, :self.used].min(1).astype(np.float64)
            # rows of one id follow each other: their estimates count together
            ids = self.ids.to_pylist()
            lo = 0
            for hi in range(1, len(ids) + 1):
                if hi == len(ids) or ids[hi] != ids[lo]:
                    every = self.best[lo:hi, :self.used].ravel()
                    if hi - lo > 1 and len(every) >= rerank:
                        least[lo:hi] = np.partition(every, len(every) - rerank)[len(every) - rerank]
                    lo = hi
            yield pa.RecordBatch.from_arrays([self.ids, pa.array(least - self.slack)], ["id", "least"])

    # a block's estimates are bounded: fewer queries where more are kept of each
    held = HELD * rerank + rows_per_group
    # the work goes by pairs, not by the rows shuffled: some tasks for each core
    tasks = max(24, TASKS * spark.sparkContext.defaultParallelism)
    rows = max(1, min(queries_per_group, CUT_BYTES // (4 * held)))
    by_cell = coded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
    cut = grid(packed(q.repartition("id").sortWithinPartitions("id"), rows, slim), packed(by_cell, rows_per_group, slim),
               Cut, T.StructType([T.StructField("id", fields[query_id]), T.StructField("least", T.DoubleType())]),
               tasks, whole=True)

    schema = T.StructType([T.StructField(query_id, fields[query_id]), indexed.schema[cand_id],
                           T.StructField("raw", T.DoubleType())])
    names, margin = schema.names, _rounding_margin(score_digits)

    class Rerank(Estimates):
        def __init__(self, block: pa.RecordBatch):
            super().__init__(block)
            self.least = np.nextafter(np.asarray(block.column("least")).astype(np.float32), np.float32(-np.inf))
            self.top = DenseTopK(self.matrix, self.ids, k, margin, exclude_self)

        def meet(self, block: pa.RecordBatch) -> None:
            x, runs = self.runs(block)
            if runs:
                m, ids, reach = dense_matrix(block.column("v")), block.column("id"), Reach(x, self.single, self.least)
            for lo, hi, which in runs:
                self.top.score(m[lo:hi], ids[lo:hi], which, reach[lo:hi])

        def rows(self):
            return self.top.rows(names)

    # the vectors of a query id or candidate id that repeats meet all its rows
    found = packed(cut.join(q, "id"), 4 * queries_per_group, slim)
    vectors = coded.join(candidates.select(F.col(cand_id).alias("id"), F.col(vec).alias("v"))
                         .where("v IS NOT NULL"), "id") \
        .repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
    scored = grid(found, packed(vectors, rows_per_group, slim), Rerank, schema, tasks, square=True)
    return _final_topk(scored.withColumn("score", F.round("raw", score_digits)), query_id, cand_id, k).drop("raw")


def reranked(pairs: DataFrame | tuple[DataFrame, DataFrame], queries: DataFrame, candidates: DataFrame, k: int, *,
             query_id: str = "query_id", cand_id: str = "vec_id", vec: str = "embedding",
             exclude_self: bool = False, rows_per_group: int = 8192, queries_per_group: int = 4096,
             score_digits: int = 6) -> DataFrame:
    """Exact dot products of the given (query_id, cand_id) pairs, ranked: (query_id,
    cand_id, score, rank), the ``k`` best of each query. Instead of the pairs two
    tables (query_id, key) and (key, cand_id) may be given, whose rows of an equal
    key are the pairs: they meet in bounded groups and are never written out. A
    null vector's score is null and ranks last."""
    if isinstance(pairs, tuple):
        scored = _grouped_scores(*pairs, queries, candidates, k, query_id, cand_id, vec, exclude_self,
                                 rows_per_group, queries_per_group, _rounding_margin(score_digits))
        return _final_topk(scored.withColumn("score", F.round("raw", score_digits)).drop("raw"),
                           query_id, cand_id, k)
    if exclude_self:
        pairs = pairs.where(F.col(query_id) != F.col(cand_id))
    both = pairs.join(queries.select(query_id, F.col(vec).alias("_q")), query_id) \
        .join(candidates.select(cand_id, F.col(vec).alias("_c")), cand_id)
    dot = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a.cast("double") * b.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    return _final_topk(both.select(query_id, cand_id, F.round(dot, score_digits).alias("score")),
                       query_id, cand_id, k)


def _grouped_scores(probes, members, queries, candidates, k, query_id, cand_id, vec, exclude_self,
                    rows_per_group, queries_per_group, margin) -> DataFrame:
    """(query_id, cand_id, raw) of what can be among the ``k`` best of its query
    within a group: a key's candidates are split into groups of about
    ``rows_per_group``, its queries into groups of about ``queries_per_group``,
    and each two groups meet once."""
    key, = set(probes.columns) - {query_id}
    q = probes.select(F.col(query_id).alias("id"), F.col(key).alias("key")) \
        .join(queries.select(F.col(query_id).alias("id"), F.col(vec).alias("v")), "id")
    c = members.select(F.col(cand_id).alias("id"), F.col(key).alias("key")) \
        .join(candidates.select(F.col(cand_id).alias("id"), F.col(vec).alias("v")), "id")

    def parts(most):
        return F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int")
    sizes = probes.groupBy(F.col(key).alias("key")).agg(parts(queries_per_group).alias("nq")).join(
        members.groupBy(F.col(key).alias("key")).agg(parts(rows_per_group).alias("nc")), "key")

    def salted(df, mine, other, mine_n, other_n):
        return df.join(sizes, "key").select(
            "key", "id", "v", F.pmod(F.xxhash64("id"), F.col(mine_n)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))
    keys = ("key", "q_part", "c_part")
    schema = T.StructType([T.StructField(query_id, probes.schema[query_id].dataType), members.schema[cand_id],
                           T.StructField("raw", T.DoubleType())])
    left = salted(q, "q_part", "c_part", "nq", "nc").groupBy(*keys)
    right = salted(c, "c_part", "q_part", "nc", "nq").groupBy(*keys)

    def score(qt: pa.Table, ct: pa.Table) -> pa.Table:
        out = []
        if qt.num_rows and ct.num_rows:
            qb, cb = qt.combine_chunks().to_batches()[0], ct.combine_chunks().to_batches()[0]
            for batch in _scored_group(qb, cb, k, margin, exclude_self, schema.names):
                out.append(batch)
        return pa.Table.from_batches(out) if out else pa.table(
            [pa.array([], to_arrow_type(f.dataType)) for f in schema.fields], schema.names)

    return left.cogroup(right).applyInArrow(score, schema)


def _lengths(col: pa.Array) -> np.ndarray:
    """Length of each vector; -1 where it or one of its values is null."""
    n = np.asarray(col.value_lengths().fill_null(-1), np.int64).copy()
    if col.flatten().null_count:
        n[[None in v for v in col.fill_null([]).to_pylist()]] = -1
    return n


def _scored_group(q: pa.RecordBatch, c: pa.RecordBatch, k, margin, exclude_self, names):
    nq, nc = _lengths(q.column("v")), _lengths(c.column("v"))
    for n in np.unique(nq):
        some = np.flatnonzero(nq == n)
        fit = np.flatnonzero(nc == n) if n >= 0 else np.zeros(0, np.int64)
        ids = q.column("id").take(pa.array(some))
        if len(fit):
            m, of = dense_matrix(c.column("v").take(pa.array(fit))), c.column("id").take(pa.array(fit))
            block = dense_matrix(q.column("v").take(pa.array(some)))
            for a in range(0, len(some), QUERY_ROWS):
                top = DenseTopK(block[a:a + QUERY_ROWS], ids[a:a + QUERY_ROWS], k, margin, exclude_self)
                for lo in range(0, len(fit), CANDIDATE_ROWS):
                    top.score(m[lo:lo + CANDIDATE_ROWS], of[lo:lo + CANDIDATE_ROWS], np.arange(len(top.matrix)))
                yield from top.rows(names)
        # without a score: the smallest ids, after all others
        rest = c.column("id").take(pa.array(np.setdiff1d(np.arange(len(nc)), fit)))
        if len(rest):
            rest = rest.take(pc.sort_indices(rest))
            plain = rest.to_numpy(zero_copy_only=False)
            for i in range(len(some)):
                at = np.flatnonzero(plain != ids[i].as_py())[:k] if exclude_self else np.arange(min(k, len(plain)))
                yield pa.RecordBatch.from_arrays(
                    [ids[i:i + 1].take(pa.array(np.zeros(len(at), np.int64))), rest.take(pa.array(at)),
                     pa.nulls(len(at), pa.float64())], names)
