"""Mixture-controlled packing by deficit round-robin over source queues.

Documents of a source form a queue of tokens. Rounds serve all queues: in each
round a queue earns a quantum in proportion to its target share of a window
(``window`` tokens over all queues), is served the whole grains (``grain``
tokens) that its credit covers, and carries the rest, its deficit, into the
next round. The served stream, in order of (round, queue), is cut every
``length`` tokens into full sequences, so nothing is padded; the rest at the
very end is cut into powers of two.

The deficit after k rounds has a closed form: with quantum q (fixed point) a
queue of T tokens has been served C(k) = min(T, floor(k q / grain) grain). So
each task places its own documents in the global stream from the queue totals
alone, and deficits carry over windows and partitions without any pass in
order. Targets default to the corpus's own mixture; other ``weights`` drain some
queues early, after which the rest share the rounds.

Work: one tokenising pass into a written table (each row's offset among its
partition's rows of the same source), one aggregate of partition totals, one
join of those offsets back (small; AQE decides how), one map. A source with a
third of all rows is as many pieces of a queue as there are partitions, never one
group. The ``QUEUES`` largest sources and those named in ``weights`` have a queue
each; the rest share ``REST`` queues by hash, all their tokens included, and keep
the target share of their queue, not each its own.

Defined cases: null text is the end id alone; a null source is a source of its
own; repeated rows are each packed; an empty table gives an empty result; other
columns are not read. Every id lies in exactly one piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import slices, staged
from .tokens import encoder, vocabulary

QUEUES, REST = 4096, 256
FIXED = 16                       # binary places of a quantum


@dataclass
class Schedule:
    """Closed form of the round-robin over the queues' totals."""
    total: np.ndarray            # tokens of each queue
    quantum: np.ndarray          # tokens a round earns, times 2^FIXED
    grain: int
    length: int

    @property
    def tokens(self) -> int:
        return int(self.total.sum())

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """(rounds, queues) tokens served after that many rounds."""
        credit = (rounds[:, None] * self.quantum[None, :]) >> FIXED
        return np.minimum(credit // self.grain * self.grain, self.total[None, :])

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        need = (token // self.grain + 1) * self.grain << FIXED
        return -(-need // self.quantum[queue])

    def cuts(self, queue: int, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a document (``n`` tokens from ``first`` of its queue) is cut
        by rounds: starts within the document, and their stream positions."""
        grains = np.arange(first // self.grain, (first + n - 1) // self.grain + 1)
        rounds = self.round_of(np.full(len(grains), queue), grains * self.grain)
        new = np.append(True, rounds[1:] != rounds[:-1])
        start = np.maximum(grains[new] * self.grain, first)
        return start - first, self.positions(queue, rounds[new], start)

    def positions(self, queue: int, rounds: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Stream position of a queue's token served in the given round."""
        out = np.zeros(len(rounds), np.int64)
        step = max(1, (1 << 20) // len(self.total))
        for lo in range(0, len(rounds), step):
            k = rounds[lo:lo + step]
            before, after = self.served(k - 1), self.served(k)
            out[lo:lo + step] = before.sum(1) + (after - before)[:, :queue].sum(1) \
                + token[lo:lo + step] - before[:, queue]
        return out

    def sequences(self, at: np.ndarray, n: np.ndarray):
        """Split runs [at, at + n) of the stream at sequence ends: (run of each
        piece, its stream position, sequence, offset, length)."""
        full = self.tokens // self.length
        tail = self.tokens - full * self.length
        ends, size = [], 1 << max(self.length.bit_length() - 1, 0)
        while size:
            if tail & size:
                ends.append(size)
            size >>= 1
        bounds = full * self.length + np.concatenate([[0], np.cumsum(ends)]).astype(np.int64)

        def seq(x):
            inside = x < bounds[0]
            return np.where(inside, x // self.length,
                            full + np.searchsorted(bounds, x, "right") - 1)

        s0, s1 = seq(at), seq(at + n - 1)
        run = np.repeat(np.arange(len(at)), s1 - s0 + 1)
        s = s0[run] + np.arange(len(run)) - np.repeat(np.cumsum(s1 - s0 + 1) - (s1 - s0 + 1),
                                                      s1 - s0 + 1)
        begin = np.where(s < full, s * self.length, bounds[np.clip(s - full, 0, len(bounds) - 1)])
        end = np.where(s < full, (s + 1) * self.length,
                       bounds[np.clip(s - full + 1, 0, len(bounds) - 1)])
        lo = np.maximum(begin, at[run])
        return run, lo, s, lo - begin, np.minimum(end, at[run] + n[run]) - lo


def schedule(totals: np.ndarray, weights: np.ndarray | None, window: int, grain: int,
             length: int) -> Schedule:
    w = totals if weights is None else weights
    share = w / max(float(w.sum()), 1e-300)
    return Schedule(totals.astype(np.int64),
                    np.maximum(np.round(share * window * (1 << FIXED)), 1).astype(np.int64),
                    grain, length)


def pack(docs: DataFrame, length: int = 1024, window: int = 65_536, grain: int = 256,
         weights: dict[str, float] | None = None, tokenizer: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of the packed documents: id_col, start, length, ids (little-endian
    u32), doc_tokens, sequence_id, offset."""
    vocab = vocabulary(tokenizer)
    spark = docs.sparkSession

    def tokenised(batches):
        enc, part, run = encoder(vocab), TaskContext.get().partitionId(), {}
        kind = np.uint16 if enc.size <= 1 << 16 else np.uint32
        for b in slices(batches, "text"):
            ids, first = enc.encode(b.column("text"))
            raw, w = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            source, before = b.column("source").to_pylist(), []
            for s, n in zip(source, np.diff(first).tolist()):
                before.append(run.get(s, 0))
                run[s] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * b.num_rows, pa.int32()), b.column("id"), b.column("source"),
                 pa.array(before, pa.int64()), pa.array(np.diff(first)),
                 pa.array([raw[w * s:w * e] for s, e in zip(first, first[1:])], pa.binary()),
                 pa.array([w] * b.num_rows, pa.int32())],
                ["part", "id", "source", "before", "n", "ids", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    rows = staged(rows.mapInArrow(tokenised, "part int, id long, source string, before long, "
                                  "n long, ids binary, width int"), "packing-tokens")

    parts = staged(rows.groupBy("part", "source").agg(F.sum("n").alias("tokens")),
                   "packing-parts")
    top = parts.groupBy("source").agg(F.sum("tokens").alias("t")) \
        .orderBy(F.desc("t"), "source").limit(QUEUES) \
        .select(F.col("source").alias("top"))
    if weights is not None:
        named = [(None if k == "\0" else k,) for k in weights]
        top = top.union(spark.createDataFrame(named, "top string")).distinct()
    top = top.withColumn("own", F.lit(True))
    same = F.col("source").eqNullSafe(F.col("top"))
    queued = parts.join(top, same, "left").withColumn(
        "queue", F.when(F.col("own"), F.concat(F.lit("="), F.coalesce("source", F.lit("\0"))))
        .otherwise(F.concat(F.lit("*"), F.pmod(F.xxhash64("source"), F.lit(REST)))))
    order = Window.partitionBy("queue").orderBy("source", "part")
    bases = queued.select(
        F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", "tokens",
        (F.sum("tokens").over(order) - F.col("tokens")).alias("base"))
    # at most QUEUES + REST rows, and one a weight
    totals = bases.groupBy("queue").agg(F.sum("tokens").alias("t")).orderBy("queue").collect()
    names = {r["queue"]: i for i, r in enumerate(totals)}
    wanted = None
    if weights is not None:
        # sources of the shared queues ("*") have no weight
        wanted = np.array([max(float(weights.get(q[1:], 0.0)), 0.0) if q[0] == "=" else 0.0
                           for q in names])
        wanted = np.maximum(wanted, 1e-6 * max(wanted.max(initial=0.0), 1.0))
    plan = schedule(np.array([r["t"] for r in totals], np.int64), wanted, window, grain, length)

    def cut(batches):
        for b in slices(batches, "ids", 2 << 20):
            cols = (b.column(x).to_pylist() for x in ("queue", "base", "before", "n"))
            doc, start, at, size = [], [], [], []
            for i, (queue, base, before, n) in enumerate(zip(*cols)):
                s, p = plan.cuts(names[queue], base + before, n)
                doc.append(np.full(len(s), i)), start.append(s), at.append(p)
                size.append(np.diff(np.append(s, n)))
            doc, start, at, size = map(np.concatenate, (doc, start, at, size))
            run, lo, seq, offset, n = plan.sequences(at, size)
            first, of = start[run] + lo - at[run], doc[run]
            width = b.column("width").to_numpy()
            wide = [np.frombuffer(x.as_py(), np.uint16 if w == 2 else np.uint32)
                    .astype("<u4").tobytes() for x, w in zip(b.column("ids"), width)]
            ids = [wide[d][4 * f:4 * (f + m)] for d, f, m in
                   zip(of.tolist(), first.tolist(), n.tolist())]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), pa.array(first), pa.array(n),
                 pa.array(ids, pa.binary()), b.column("n").take(take), pa.array(seq),
                 pa.array(offset)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    on = (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))
    pieces = rows.join(bases.drop("tokens"), on).select(
        "id", "queue", "base", "before", "n", "ids", "width").mapInArrow(
        cut, "id long, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)
