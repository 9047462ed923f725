"""Exact top-k between two tables as a grid of row blocks.

Both sides are packed, partition by partition and without a shuffle, into blocks
of a bounded number of rows (and bytes), one row per block with the rows as an
Arrow payload. Candidate blocks are dealt onto the cells of the grid's one axis,
every query block is sent to all cells, and a sort-merge join on the cell brings
each (query block, candidate block) pair together once: one shuffle, nothing on
the driver, one plan at every size. A pair is scored at once in numpy; a task
holds one query block with its running top-k and one pair.

``Running`` is that state: it keeps, per query, what can still be among the k
best, and its floor (the k-th best so far) lets a pair be skipped or cut down by
a bound before it is scored. States of different cells merge by a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of one block: rows of the query side, rows of the candidate side, and
# the bytes of either (a longer row stands alone).
QUERY_ROWS = 1024
CANDIDATE_ROWS = 512
BLOCK_BYTES = 8 << 20
#: Rows held beyond twice the pruned ones before the next pruning.
SLACK = 50_000
#: Cells of the grid for each core at most.
TASKS = 4


def payload(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def opened(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def row_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in groups of at most ``rows`` rows, ended early
    by ``BLOCK_BYTES``."""
    held, count, size = [], 0, 0

    def closed() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, min(rows - count, b.num_rows - at))
            while part.num_rows > 1 and size + part.nbytes > BLOCK_BYTES:
                part = part.slice(0, part.num_rows // 2)
            if held and size + part.nbytes > BLOCK_BYTES:
                yield closed()
                held, count, size = [], 0, 0
                continue
            held.append(part)
            at, count, size = at + part.num_rows, count + part.num_rows, size + part.nbytes
            if count >= rows:
                yield closed()
                held, count, size = [], 0, 0
    if held:
        yield closed()


def packed(df: DataFrame, rows: int,
           build: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """(block, payload): the rows of ``df`` in blocks; ``build`` makes the
    payload of a block from its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, group in enumerate(row_groups(batches, rows)):
            data = payload(build(group) if build else group)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | i], pa.int64()), pa.array([data], pa.binary())],
                ["block", "payload"])

    return df.mapInArrow(run, "block long, payload binary")


def spark_hash(value: int) -> int:
    """Spark's ``hash`` of an int (Murmur3, seed 42)."""
    def rotated(x, n):
        return (x << n | x >> (32 - n)) & 0xFFFFFFFF
    k = rotated(value * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = rotated(42 ^ k, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def cell_keys(n: int) -> list[int]:
    """``n`` keys that hash into ``n`` different partitions, so that cells are
    dealt evenly."""
    keys: dict[int, int] = {}
    value = 0
    while len(keys) < n:
        keys.setdefault(spark_hash(value) % n, value)
        value += 1
    return [keys[p] for p in range(n)]


def grid(queries: DataFrame, candidates: DataFrame,
         start: Callable[[pa.RecordBatch], object], schema: T.StructType,
         cells: int | None = None, whole: bool = False, square: bool = False) -> DataFrame:
    """Every packed query block against every packed candidate block.
    ``start(query block)`` gives a state with ``meet(candidate block)`` and
    ``rows()``, the batches of its result. With ``whole`` the candidate blocks
    are sent to all cells and the query blocks dealt, so that one state meets all
    candidates. With ``square`` the cells have two axes: a query block is sent to
    the cells of a row and a candidate block to those of a column, which for n
    cells makes about sqrt(n) copies and states of each block instead of n. The
    copies sent grow with the cells: there are no more than ``TASKS`` for each core."""
    spark = queries.sparkSession
    n = cells or min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                     max(24, TASKS * spark.sparkContext.defaultParallelism))
    cols = 1 if whole else math.isqrt(n) if square else n
    rows = n // cols
    n = rows * cols
    keys = F.lit(cell_keys(n))
    place = F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)

    def sent(first, step, copies):
        """The cells of a block: ``copies`` of them, ``step`` apart."""
        if copies == n:
            return F.explode(keys)
        first = (first + 1).cast("int")
        if copies == 1:
            return F.element_at(keys, first)
        return F.explode(F.transform(F.sequence(first, first + step * (copies - 1), F.lit(step)),
                                     lambda i: F.element_at(keys, i)))
    q = queries.select(F.col("payload").alias("q"), F.col("block").alias("q_block"),
                       sent(F.pmod(place, F.lit(rows)) * cols, 1, cols).alias("cell"))
    c = candidates.select(sent(F.pmod(place, F.lit(cols)), cols, rows).alias("cell"), F.col("payload").alias("c"))
    # fixed numbers of partitions: the cells are the unit of work, however small
    pairs = q.repartition(n, "cell").join(c.repartition(n, "cell").hint("merge"), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the pairs of a query block follow each other; were they split, each
        # run would give its own best rows, which the window merges
        block, state = None, None
        for b in batches:
            for k, qd, cd in zip(b.column("q_block").to_pylist(), b.column("q"), b.column("c")):
                if state is None or k != block:
                    if state is not None:
                        yield from state.rows()
                    block, state = k, start(opened(qd.as_buffer()))
                state.meet(opened(cd.as_buffer()))
        if state is not None:
            yield from state.rows()

    return pairs.select("q_block", "q", "c").mapInArrow(run, schema)


class Running:
    """Running top-k of a block of queries. Rows within ``margin`` of the k-th
    value stay (the last ranking rounds); of rows with the very same value only
    the k smallest ids can matter, so ties do not pile up. Ids may be structs of
    the id and what goes with it."""

    def __init__(self, n: int, k: int, margin: float = 0.0, least: float = -np.inf):
        self.k, self.margin, self.least = k, margin, least
        self.floor = np.full(n, -np.inf)
        self.held: list[tuple] = []
        self.size, self.kept = 0, 0

    def offer(self, scores: np.ndarray, ids: pa.Array, which: np.ndarray) -> None:
        """``scores`` of (candidate, query ``which``)."""
        n = len(scores)
        if n >= self.k:
            best = np.partition(scores, n - self.k, axis=0)[n - self.k]
            self.floor[which] = np.maximum(self.floor[which], best)
        row, col = np.nonzero((scores >= self.floor[which] - self.margin) & (scores > self.least))
        if len(row):
            self.held.append((which[col], scores[row, col], ids.take(pa.array(row))))
            self.size += len(row)
            if self.size > 2 * self.kept + SLACK:
                self.prune()

    def add(self, scores: np.ndarray, row: np.ndarray, which: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of single pairs: candidate ``row`` with query ``which``."""
        near = np.flatnonzero((scores >= self.floor[which] - self.margin) & (scores > self.least))
        if len(near):
            self.held.append((which[near], scores[near], ids.take(pa.array(row[near]))))
            self.size += len(near)
            if self.size > 2 * self.kept + SLACK:
                self.prune()

    def prune(self) -> None:
        query = np.concatenate([h[0] for h in self.held])
        value = np.concatenate([h[1] for h in self.held])
        ids = pa.concat_arrays([h[2] for h in self.held])
        by = ids.field(0) if pa.types.is_struct(ids.type) else ids
        order = pc.sort_indices(pa.table({"q": query, "v": value, "i": by}), sort_keys=[
            ("q", "ascending"), ("v", "descending"), ("i", "ascending")]).to_numpy()
        query, value = query[order], value[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        size = np.diff(np.append(first, len(query)))
        full = size >= self.k
        kth = first[full] + self.k - 1
        self.floor[query[kth]] = np.maximum(self.floor[query[kth]], value[kth])
        run = np.append(True, (query[1:] != query[:-1]) | (value[1:] != value[:-1]))
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(run, np.arange(len(query)), 0))
        stay = (place < self.k) & (value >= self.floor[query] - self.margin)
        self.held = [(query[stay], value[stay], ids.take(pa.array(order[stay])))]
        self.size = self.kept = int(stay.sum())

    def rows(self, query_ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.prune()
            query, value, ids = self.held[0]
            ids = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query)), *ids, pa.array(value)], names)


def list_offsets(col: pa.Array) -> np.ndarray:
    """Offsets of a list column's values in ``flatten()``; null as empty."""
    size = col.value_lengths().fill_null(0)
    return np.concatenate([[0], np.cumsum(np.asarray(size, np.int64))])
