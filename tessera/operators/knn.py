"""Top-k similarity search between a query table and a candidate table
(T1 exact, T7 approximate, J6, W2).

Exact search (dense vectors, hashed term counts) runs on the grid of
:mod:`tessera.operators.grid`: blocks of queries meet blocks of candidates once,
each pair is one numpy product in a task with a running top-k, and a window
(``row_number() <= k``, planned as a WindowGroupLimit before its shuffle) merges
the tasks' rows. There is one plan at every size and neither side passes through
the driver or a broadcast. Dense pairs are skipped for the queries whose k-th
best score exceeds the bound ``q.m + |q| r`` of the candidate block (m its mean,
r the greatest distance from it).

``method="join"`` of the sparse form joins exploded terms instead; it makes one
row per pair that shares a term and serves as a cross-check.

Approximate search (IVF): KMeans cells over the candidates, each query
probes its ``nprobe`` nearest cells, candidates and probing queries meet by
an equi-join on (cell, salt) and are scored per group with NumPy. Big cells
are split into salted sub-groups, so one hot cell never lands in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embed import hashed_counts
from .grid import CANDIDATE_ROWS, QUERY_ROWS, Running, grid, list_offsets, packed

# Bytes (float64) of the matrix of one block of queries.
QUERY_MATRIX_BYTES = 16 << 20
# Blocks of vectors are so many times longer than those of terms.
DENSE_BLOCKS = 2


def empty_frame(schema: T.StructType) -> pd.DataFrame:
    """An empty pandas result with dtypes matching ``schema`` (a bare
    ``pd.DataFrame({c: []})`` is float64, which a string column rejects)."""
    def dtype(t):
        if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
            return "int64"
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return "float64"
        return object
    return pd.DataFrame({f.name: pd.Series([], dtype=dtype(f.dataType)) for f in schema.fields})


def _final_topk(cands: DataFrame, query_id: str, cand_id: str, k: int,
                order_col: str = "score") -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.col(order_col).desc(),
                                             F.col(cand_id).asc())
    return (cands.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def _rounding_margin(digits: int) -> float:
    """Values that round alike differ by less than one unit of the last digit."""
    return 1.01 * 10.0 ** (-digits)


def _batch_topk(S: np.ndarray, k: int, margin: float = 0.0, least: float = 0.0):
    """Row/column indexes of every entry within the top-k of its column
    (ties and anything within ``margin`` of the k-th value kept) above
    ``least``: 0 where only shared terms count, -inf for dense vectors."""
    B = S.shape[0]
    if B > k:
        thr = np.partition(S, B - k, axis=0)[B - k]
        mask = (S >= (thr - margin)[None, :]) & (S > least)
    else:
        mask = S > least
    return np.nonzero(mask)


def _running_topk(frames, query_id: str, score: str, k: int, margin: float = 0.0):
    """One frame per partition: the rows of ``frames`` within the top-k of
    their query (ties and ``margin`` kept), pruned as they come, so neither
    memory nor output grows with the number of batches."""
    held, rows, kept = [], 0, 0

    def prune():
        df = pd.concat(held, ignore_index=True)
        s = df[score].to_numpy()
        q = pd.factorize(df[query_id], use_na_sentinel=False)[0]
        order = np.lexsort((-s, q))
        first = np.searchsorted(q[order], np.arange(q.max() + 2))
        kth = s[order][first[:-1] + np.minimum(k, np.diff(first)) - 1]
        return df[s >= kth[q] - margin]

    for f in frames:
        held.append(f)
        rows += len(f)
        if rows > 2 * kept + 50_000:
            held = [prune()]
            rows = kept = len(held[0])
    if rows:
        yield prune()


# ---------------------------------------------------------------------------
# sparse integer vectors (hashed term counts)
# ---------------------------------------------------------------------------

def topk_sparse(queries: DataFrame, candidates: DataFrame, k: int, dim: int, *,
                query_id: str = "query_id", cand_id: str = "chunk_id",
                carry: tuple[str, ...] = (), beside: tuple[str, ...] = (), method: str = "auto",
                budget: int = QUERY_MATRIX_BYTES) -> DataFrame:
    """Exact top-k by cosine of hashed count vectors.

    ``queries``: (query_id, buckets, tfs, ss); ``candidates``: (cand_id,
    buckets, tfs, ss, *carry), ``cand_id`` unique; on the grid also (cand_id, tokens,
    *carry), whose counts are then hashed where they are packed. Returns (query_id, cand_id,
    score, rank, *carry), only pairs sharing at least one bucket (score > 0),
    ordered per query by score desc then cand_id. ``budget`` bounds the matrix
    of a query block. ``method``: the grid (``auto``; ``broadcast`` is its older
    name) or ``join``. The carried columns are joined to the hits by ``cand_id``;
    those ``beside`` it (small ones) go with each candidate through the grid.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if method not in ("auto", "broadcast", "join"):
        raise ValueError(method)
    # rows with no term (ss = 0) never score > 0; they are skipped by the
    # scorers rather than filtered here, so the vector expression is not
    # duplicated into a pushed-down predicate
    q = queries.select(query_id, "buckets", "tfs", "ss")
    c = candidates
    if method == "join":
        return _sparse_join(q, c, k, query_id, cand_id, carry + beside)
    rows = max(1, min(QUERY_ROWS, budget // (8 * dim)))
    schema = T.StructType([T.StructField(query_id, q.schema[query_id].dataType),
                           *(c.schema[x] for x in (cand_id, *beside)), T.StructField("score", T.DoubleType())])
    names = schema.names

    def dense(block: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((block.num_rows, dim))
        off = list_offsets(block.column("buckets"))
        row = np.repeat(np.arange(block.num_rows), np.diff(off))
        out[row, np.asarray(block.column("buckets").flatten(), np.int64)] = \
            np.asarray(block.column("tfs").flatten(), np.float64)
        return out

    class State:
        def __init__(self, block: pa.RecordBatch):
            self.norm = np.sqrt(np.asarray(block.column("ss").fill_null(0), np.float64))
            self.which = np.flatnonzero(self.norm)
            self.ids = block.column(query_id)
            self.matrix = dense(block)[self.which].T
            self.best = Running(block.num_rows, k, 0.0, 0.0)

        def meet(self, block: pa.RecordBatch) -> None:
            norm = np.sqrt(np.asarray(block.column("ss").fill_null(0), np.float64))
            some = np.flatnonzero(norm)
            if len(some) and len(self.which):
                scores = (dense(block)[some] @ self.matrix) / (self.norm[self.which] * norm[some, None])
                ids = block.column(cand_id)
                if beside:
                    ids = pa.StructArray.from_arrays([ids, *(block.column(x) for x in beside)], [cand_id, *beside])
                self.best.offer(scores, ids.take(pa.array(some)), self.which)

        def rows(self):
            return self.best.rows(self.ids, names)

    def hashed(block: pa.RecordBatch) -> pa.RecordBatch:
        kept = [cand_id, *beside]
        return pa.RecordBatch.from_arrays(
            [*(block.column(x) for x in kept), *hashed_counts(block.column("tokens"), dim)],
            [*kept, "buckets", "tfs", "ss"])

    blocks = packed(c.select(cand_id, *beside, "tokens"), CANDIDATE_ROWS, hashed) if "tokens" in c.columns \
        else packed(c.select(cand_id, *beside, "buckets", "tfs", "ss"), CANDIDATE_ROWS)
    scored = grid(packed(q, rows), blocks,
                  State, schema)
    top = _final_topk(scored, query_id, cand_id, k)
    if carry:      # hits are bounded by queries x k; AQE broadcasts them if small
        top = top.join(c.select(cand_id, *carry), cand_id)
    return top


def _sparse_join(q, c, k, query_id, cand_id, carry):
    qx = (q.select(query_id, F.col("ss").alias("qss"),
                   F.explode(F.arrays_zip("buckets", "tfs")).alias("e"))
          .select(query_id, "qss", F.col("e.buckets").alias("bucket"),
                  F.col("e.tfs").alias("qtf")))
    cx = (c.select(cand_id, F.col("ss").alias("css"),
                   F.explode(F.arrays_zip("buckets", "tfs")).alias("e"))
          .select(cand_id, "css", F.col("e.buckets").alias("bucket"),
                  F.col("e.tfs").alias("ctf")))
    dots = (cx.join(qx, "bucket")
            .groupBy(query_id, cand_id)
            .agg(F.sum(F.col("qtf").cast("bigint") * F.col("ctf")).alias("dot"),
                 F.first("qss").alias("qss"), F.first("css").alias("css")))
    scored = dots.select(
        query_id, cand_id,
        (F.col("dot").cast("double")
         / (F.sqrt(F.col("qss").cast("double")) * F.sqrt(F.col("css").cast("double"))))
        .alias("score"))
    top = _final_topk(scored, query_id, cand_id, k)
    if carry:
        # hits are bounded by queries x k; Spark/AQE broadcast them if small
        top = top.join(c.select(cand_id, *carry), cand_id)
    return top


# ---------------------------------------------------------------------------
# dense float vectors
# ---------------------------------------------------------------------------

class DenseTopK:
    """Running top-k by dot product of a block of queries. A pair is first scored
    in single precision; only pairs that can still reach the k best, by that
    score and its greatest error, are scored in double precision."""

    def __init__(self, matrix: np.ndarray, ids: pa.Array, k: int, margin: float, exclude_self: bool):
        self.ids, self.matrix = ids, matrix
        self.plain = ids.to_numpy(zero_copy_only=False) if exclude_self else None
        self.norm = np.linalg.norm(matrix, axis=1)
        self.best = Running(len(matrix), k, margin)
        # a sum of n products is off by n + 2 roundings of |q| |c| at most
        self.error = (matrix.shape[1] + 2) * 2.0 ** -23
        self.single = matrix.astype(np.float32) if self.norm.max(initial=0) < 1e15 else None

    def score(self, m: np.ndarray, ids: pa.Array, which: np.ndarray, allowed=None) -> None:
        """Score candidates ``m`` with the queries ``which``. ``allowed`` tells which
        pairs count: ``mask(queries)`` of all its candidates, ``pairs(candidates,
        queries)`` one by one; a slice of it is for a slice of the candidates."""
        floor = self.best.floor[which]
        reach = np.linalg.norm(m, axis=1).max(initial=0)
        known = np.isfinite(floor) if self.single is not None and reach < 1e15 else np.zeros(len(which), bool)
        if known.any():
            self._near(m, ids, which[known], reach, allowed)
        if not known.all():        # a first slice gives their floors
            new = which[~known]
            self._all(m[:FIRST_ROWS], ids[:FIRST_ROWS], new, allowed and allowed[:FIRST_ROWS])
            if len(m) > FIRST_ROWS:
                self.score(m[FIRST_ROWS:], ids[FIRST_ROWS:], new, allowed and allowed[FIRST_ROWS:])

    def _all(self, m, ids, which, allowed) -> None:
        scores = m @ self.matrix[which].T
        if allowed:
            scores[~allowed.mask(which)] = -np.inf
        if self.plain is not None:
            mine = ids.to_numpy(zero_copy_only=False)
            scores[mine[:, None] == self.plain[None, which]] = -np.inf
        self.best.offer(scores, ids, which)

    def _near(self, m, ids, which, reach, allowed) -> None:
        best = self.best
        least = best.floor[which] - best.margin - self.error * reach * self.norm[which] - 1e-30
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        near = m.astype(np.float32) @ self.single[which].T >= least
        row, col = np.divmod(_places(near), len(which))
        if self.plain is not None:
            other = ids.to_numpy(zero_copy_only=False)[row] != self.plain[which[col]]
            row, col = row[other], col[other]
        for lo in range(0, len(row), EXACT_PAIRS):
            r, q = row[lo:lo + EXACT_PAIRS], which[col[lo:lo + EXACT_PAIRS]]
            if allowed:
                count = allowed.pairs(r, q)
                r, q = r[count], q[count]
            best.add(np.einsum("ij,ij->i", m[r], self.matrix[q]), r, q, ids)

    def rows(self, names):
        return self.best.rows(self.ids, names)


def _places(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask with few true values, by words of eight."""
    flat = mask.ravel()
    n = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.append(at[flat[at]], n + np.flatnonzero(flat[n:]))


# Pairs scored in double precision at once, and candidates that are all scored
# so where a query has no k best yet.
EXACT_PAIRS = 1 << 15
FIRST_ROWS = 256


def dense_matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def topk_dense(queries: DataFrame, candidates: DataFrame, k: int, *,
               query_id: str = "query_id", cand_id: str = "vec_id",
               vec: str = "embedding", exclude_self: bool = False,
               budget: int = QUERY_MATRIX_BYTES,
               score_digits: int = 6) -> DataFrame:
    """Exact top-k by dot product (cosine for unit vectors).

    Returns (query_id, cand_id, score, rank); ``score`` is rounded to
    ``score_digits`` and the order is rounded score desc, cand_id asc, so
    engines whose float sums differ in the last bits rank alike. Null vectors
    take no part. ``budget`` bounds the matrix of a query block.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    q = queries.select(F.col(query_id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")
    c = candidates.select(F.col(cand_id).alias("id"), F.col(vec).alias("v")).where("v IS NOT NULL")
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        candidates.schema[cand_id], T.StructField("raw", T.DoubleType())])
    names, margin = schema.names, _rounding_margin(score_digits)

    class State(DenseTopK):
        def __init__(self, block: pa.RecordBatch):
            super().__init__(dense_matrix(block.column("v")), block.column("id"), k, margin, exclude_self)

        def meet(self, block: pa.RecordBatch) -> None:
            m = dense_matrix(block.column("v"))
            mean = m.mean(0)
            bound = self.matrix @ mean + self.norm * np.sqrt(((m - mean) ** 2).sum(1).max())
            which = np.flatnonzero(bound * (1 + 1e-9) + 1e-9 >= self.best.floor - margin)
            for lo in range(0, len(which), rows):
                self.score(m, block.column("id"), which[lo:lo + rows])

        def rows(self):
            return super().rows(names)

    rows = max(1, min(DENSE_BLOCKS * QUERY_ROWS, budget // (8 * 64)))
    scored = grid(packed(q, rows), packed(c, DENSE_BLOCKS * CANDIDATE_ROWS), State, schema)
    scored = scored.withColumn("score", F.round("raw", score_digits))
    return _final_topk(scored, query_id, cand_id, k).drop("raw")


# ---------------------------------------------------------------------------
# approximate: IVF over KMeans cells
# ---------------------------------------------------------------------------

def ivf_index(candidates: DataFrame, *, cand_id: str = "vec_id",
              vec: str = "embedding", nlist: int = 20, seed: int = 7,
              max_iter: int = 20):
    """Train ``nlist`` KMeans centroids on the candidates and assign each
    candidate its cell. Returns (assigned DataFrame (cand_id, vec, cell),
    centroid matrix nlist x d). The centroids are nlist x d numbers -- a
    bounded broadcast."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = candidates.select(cand_id, vec, array_to_vector(vec).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter,
                   featuresCol="features", predictionCol="cell").fit(feats)
    assigned = model.transform(feats).select(cand_id, vec, F.col("cell").cast("int"))
    return assigned, np.asarray(model.clusterCenters(), dtype=np.float64)


def topk_ivf(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray,
             k: int, nprobe: int, *, query_id: str = "query_id",
             cand_id: str = "vec_id", vec: str = "embedding",
             exclude_self: bool = False, salts: int | None = None,
             rows_per_group: int = 20_000, queries_per_group: int = 2_000,
             score_digits: int = 6) -> DataFrame:
    """Approximate top-k: each query is scored only against the candidates of
    its ``nprobe`` nearest cells (Euclidean centroid distance).

    Both sides of a cell are split: candidates into ``ceil(size /
    rows_per_group)`` salts, the queries probing it into ``ceil(probes /
    queries_per_group)`` salts, and every (candidate salt, query salt) pair
    is one group -- candidates are replicated across query salts and queries
    across candidate salts. A group therefore holds at most
    ``rows_per_group`` candidates and ``queries_per_group`` queries whatever
    the skew (a hot cell, or a k-NN graph where every vector is a query).
    Salt counts come from two small aggregates (nlist rows each). Each group
    emits only its per-query top-k. Returns (query_id, cand_id, score, rank,
    scored), ``scored`` = candidates in the probed cells.
    """
    spark = queries.sparkSession
    nlist, d = centroids.shape
    nprobe = max(1, min(nprobe, nlist))
    q = probe_cells(queries, centroids, nprobe, query_id, vec)
    probes = q.select(query_id, "_qv", F.explode("_cells").alias("cell"))
    margin = _rounding_margin(score_digits)
    out_schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType), assigned.schema[cand_id],
        T.StructField("raw", T.DoubleType())])

    def score_group(key, qpdf, cpdf):
        if len(qpdf) == 0 or len(cpdf) == 0:
            return empty_frame(out_schema)
        C = np.stack(cpdf[vec].to_numpy()).astype(np.float64)
        cids = cpdf[cand_id].to_numpy()
        outs = []
        for lo in range(0, len(qpdf), QUERY_BLOCK):      # bounded score blocks
            part = qpdf.iloc[lo:lo + QUERY_BLOCK]
            Q = np.stack(part["_qv"].to_numpy()).astype(np.float64)
            qids = part[query_id].to_numpy()
            S = C @ Q.T
            if exclude_self:
                S[cids[:, None] == qids[None, :]] = -np.inf
            r, c = _batch_topk(S, k, margin, -np.inf)
            outs.append((qids[c], cids[r], S[r, c]))
        # one frame from concatenated arrays (see scoped_topk)
        return pd.DataFrame({query_id: np.concatenate([o[0] for o in outs]),
                             cand_id: np.concatenate([o[1] for o in outs]),
                             "raw": np.concatenate([o[2] for o in outs])})

    scored, sizes = cell_groups(probes, assigned, query_id, cand_id, score_group, out_schema,
                                salts, rows_per_group, queries_per_group)
    # candidates each query was compared with, from the cell sizes
    cell_sizes = spark.createDataFrame([(c, n) for c, n in sizes.items()], "cell int, n long")
    scored_counts = (q.select(query_id, F.explode("_cells").alias("cell"))
                     .join(F.broadcast(cell_sizes), "cell")
                     .groupBy(query_id).agg(F.sum("n").alias("scored")))
    top = (_final_topk(scored.withColumn("score", F.round("raw", score_digits)),
                       query_id, cand_id, k)
           .drop("raw"))
    return top.join(scored_counts, query_id, "left")


QUERY_BLOCK = 256


def probe_cells(queries: DataFrame, centroids: np.ndarray, nprobe: int, query_id: str,
                vec: str, maps: bool = False) -> DataFrame:
    """(query_id, _qv, _cells): the ``nprobe`` cells whose centroid is nearest
    in Euclidean distance, the metric the cells were made with; with ``maps`` as a
    bit map, which for many cells is shorter by far. The centroids (a bounded
    matrix) travel in the task closure."""
    half = 0.5 * (centroids * centroids).sum(1)
    q = queries.select(F.col(query_id), F.col(vec).alias("_qv")).where("_qv IS NOT NULL")
    schema = T.StructType([*q.schema.fields, T.StructField(
        "_cells", T.BinaryType() if maps else T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            Q = np.asarray(b.column("_qv").flatten(), np.float64).reshape(b.num_rows, -1)
            best = np.argsort(half - Q @ centroids.T, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
            if maps:
                probed = np.zeros((b.num_rows, len(centroids)), bool)
                probed[np.arange(b.num_rows)[:, None], best] = True
                cells = pa.array([x.tobytes() for x in np.packbits(probed, axis=1)], pa.binary())
            else:
                cells = pa.ListArray.from_arrays(
                    pa.array(np.arange(b.num_rows + 1) * best.shape[1], pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], schema.names)

    return q.mapInArrow(run, schema)


def cell_groups(probes: DataFrame, assigned: DataFrame, query_id: str, cand_id: str, score_group,
                out_schema: T.StructType, salts: int | None = None, rows_per_group: int = 20_000,
                queries_per_group: int = 2_000) -> tuple[DataFrame, dict[int, int]]:
    """``score_group(key, queries, candidates)`` of every bounded group of probing
    queries and candidates of a cell, and the cell sizes."""
    sizes = {int(r["cell"]): int(r["count"]) for r in assigned.groupBy("cell").count().collect()}
    n_probes = {int(r["cell"]): int(r["count"]) for r in probes.groupBy("cell").count().collect()}
    c_salts = {c: (salts or max(1, math.ceil(n / rows_per_group))) for c, n in sizes.items()}
    q_salts = {c: max(1, math.ceil(n / queries_per_group)) for c, n in n_probes.items()}

    def salt_map(m):
        if not m:
            return F.create_map().cast("map<int,int>")
        return F.create_map(*[x for c, v in m.items() for x in (F.lit(c), F.lit(v))])

    nc = F.coalesce(salt_map(c_salts)[F.col("cell")], F.lit(1))
    nq = F.coalesce(salt_map(q_salts)[F.col("cell")], F.lit(1))
    # the salt keys must have the same type on both cogrouped sides
    cands = (assigned.withColumn("c_salt", F.pmod(F.xxhash64(cand_id), nc).cast("int"))
             .withColumn("q_salt", F.explode(F.sequence(F.lit(0), (nq - 1).cast("int")))))
    probes = (probes.withColumn("q_salt", F.pmod(F.xxhash64(query_id), nq).cast("int"))
              .withColumn("c_salt", F.explode(F.sequence(F.lit(0), (nc - 1).cast("int")))))
    keys = ("cell", "c_salt", "q_salt")
    return (probes.groupBy(*keys).cogroup(cands.groupBy(*keys))
            .applyInPandas(score_group, out_schema)), sizes
