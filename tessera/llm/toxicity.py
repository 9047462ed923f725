"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased letter runs of a text and their prefixes of four and
six bytes (a stem met with an unseen ending is still known). Every term is
hashed into one of 2^``BITS`` buckets; none is selected or left out. The machine
scores the set x of a text's buckets as

    b + sum_i w_i + sum_{i<j} <v_i, v_j>

so pairs of terms, an insult with a group mention, have a weight of their own,
also where neither term tells anything alone.

It is trained in numpy, in one task, on a bounded labelled sample (``bound``
rows, a parameter of ``fit``): stochastic gradient steps, smaller for buckets
that many texts hold. ``w`` is soft-thresholded in proportion to the noise of its
gradient, the root of a bucket's rows; ``v`` shrinks by so much that the terms of
one text cannot learn that text by heart together. What stays (buckets with a weight, a few thousand, at
most 2^``BITS``) travels in the task closure and scores every whole text.

Defined cases: null and empty texts, and texts without a weighted bucket, get
the score of the empty set; without labels of both classes every score is the
smoothed share of toxic rows; repeated rows are scored alike; other columns
are kept as they are; ids may have any type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .base import LETTER, Words, slices, span_hashes
from .labelled import labelled_sample

PREFIX_BYTES = (4, 6)
BITS = 18


def _terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every term occurrence: whole words, and prefixes."""
    w = Words(col, LETTER)
    rows = w.rows()
    at, terms = [rows], [w.hashes()]
    for n in PREFIX_BYTES:
        long = w.end - w.start > n
        start = w.start[long]
        at.append(rows[long])
        terms.append(span_hashes(w.data, start, start + n) ^ np.uint64(0xA5A5A5A5))
    return np.concatenate(at), np.concatenate(terms)


def _bucket(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BITS)).astype(np.int64)


def _sets(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term), ordered."""
    o = np.lexsort((terms, rows))
    rows, terms = rows[o], terms[o]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


@dataclass
class Model:
    bias: float
    buckets: np.ndarray    # those with a weight, sorted
    w: np.ndarray          # (buckets,)
    v: np.ndarray          # (buckets, factors)
    rows: int = 0          # of the sample

    def __post_init__(self):
        self.slot = np.full(1 << BITS, -1, np.int32)
        self.slot[self.buckets] = np.arange(len(self.buckets))

    def known(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the distinct weighted buckets of each text."""
        rows, t = _terms(col)
        at = self.slot[_bucket(t)]
        return _sets(rows[at >= 0], at[at >= 0])

    def margin(self, rows, at, n) -> np.ndarray:
        """Scores before the logistic."""
        v = self.v[at]
        s = np.stack([np.bincount(rows, v[:, f], n) for f in range(v.shape[1])], 1)
        q = np.bincount(rows, (v * v).sum(1), n)
        return self.bias + np.bincount(rows, self.w[at], n) + 0.5 * ((s * s).sum(1) - q)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(first: np.ndarray, at: np.ndarray, y: np.ndarray, factors: int = 8,
          epochs: int = 15, batch: int = 32, seed: int = 7) -> Model:
    """Fit on texts given as buckets ``at[first[i]:first[i + 1]]``, each once;
    a small sample is gone through more often than ``epochs`` times."""
    rng = np.random.default_rng(seed)
    n, size = len(y), 1 << BITS
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if not n or y.min() == y.max() or not len(at):
        return Model(bias, none, np.zeros(0), np.zeros((0, factors)), n)
    epochs = max(epochs, min(200, 100_000 // n))
    held = np.bincount(at, minlength=size)
    per_row = len(at) / n
    noise = np.sqrt(held * share * (1 - share))
    w = np.zeros(size, np.float32)
    v = rng.normal(0, 0.02, (size, factors)).astype(np.float32)
    v[held == 0] = 0
    pace = ((1 - held / n)).astype(np.float32)
    shrink = 1.5 * per_row * pace
    cut = 0.5 + noise / 2
    rate, rate_b = 0.5 / per_row, 0.003
    rate_w = (0.3 / np.sqrt(np.maximum(held, 4))).astype(np.float32)
    for epoch in range(epochs):
        slow = 1 / (1 + 2 * epoch / epochs)
        order = rng.permutation(n)
        since = 0
        for k, lo in enumerate(range(0, n, batch)):
            pick = order[lo:lo + batch]
            count = first[pick + 1] - first[pick]
            off = np.cumsum(count) - count
            idx = at[np.repeat(first[pick] - off, count) + np.arange(count.sum())]
            text = np.repeat(np.arange(len(pick)), count)
            u = v[idx]
            z = np.full(len(pick), bias, np.float32)
            s = np.zeros((len(pick), factors), np.float32)
            some = np.flatnonzero(count)
            if len(some):
                s[some] = np.add.reduceat(u, off[some], axis=0)
                z[some] += np.add.reduceat(w[idx] - 0.5 * (u * u).sum(1), off[some])
            z += 0.5 * (s * s).sum(1)
            g = (sigmoid(z) - y[pick]).astype(np.float32)
            bias -= slow * rate_b * float(g.sum())
            np.add.at(w, idx, -slow * rate_w[idx] * g[text])
            np.add.at(v, idx, (-slow * rate * pace[idx] * g[text])[:, None] * (s[text] - u))
            since += len(pick)
            if k % 16 == 15 or lo + batch >= n:        # the penalties of the rows since
                v *= np.exp(-slow * rate * since / n * shrink).astype(np.float32)[:, None]
                w = np.sign(w) * np.maximum(np.abs(w) - slow * rate_w * since / n * cut, 0) \
                    .astype(np.float32)
                since = 0
    v[np.abs(v).max(1) < 1e-2] = 0                      # shrunk away
    kept = np.flatnonzero((w != 0) | v.any(1))
    return Model(bias, kept, w[kept].astype(float), v[kept].astype(float), n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 10_000,
        factors: int = 8, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``bound`` rows of ``labels``."""
    sample = labelled_sample(docs, labels, label, bound, id_col, text_col)
    schema = StructType([sample.schema["id"], StructField("y", DoubleType()),
                         StructField("at", ArrayType(IntegerType()))])

    def hashed(batches):
        for b in slices(batches, "text"):
            rows, t = _terms(b.column("text"))
            rows, at = _sets(rows, _bucket(t))
            first = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("y").cast(pa.float64()),
                 pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32()))],
                schema.names)

    def trained(batches):
        parts = list(batches)
        y, at, first = np.zeros(0), np.zeros(0, np.int32), np.zeros(1, np.int64)
        if parts:
            y = np.concatenate([np.asarray(b.column("y")) for b in parts])
            lists = [b.column("at") for b in parts]
            size = np.concatenate([np.asarray(x.value_lengths()) for x in lists])
            first = np.concatenate([[0], np.cumsum(size)])
            at = np.concatenate([np.asarray(x.flatten()) for x in lists])
        m = train(first, at, y, factors)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), pa.array([m.rows], pa.int64()),
             *(pa.array([a.tobytes()], pa.binary()) for a in
               (m.buckets.astype("<i8"), m.w.astype("<f8"), m.v.astype("<f8")))],
            ["bias", "rows", "buckets", "w", "v"])

    # one task: at most `bound` rows of bucket numbers, ordered by id
    x = sample.mapInArrow(hashed, schema).repartition(1).sortWithinPartitions("id", "y")
    got = x.mapInArrow(trained, "bias double, rows long, buckets binary, w binary, v binary").first()
    if got is None:
        return train(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), factors)
    return Model(got["bias"], np.frombuffer(got["buckets"], "<i8"), np.frombuffer(got["w"], "<f8"),
                 np.frombuffer(got["v"], "<f8").reshape(-1, factors), got["rows"])


def score(docs: DataFrame, model: Model, text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) appended; all columns are kept, but
    one of that name is replaced."""
    docs = docs.drop(score_col)
    fields = [*docs.schema.names, score_col]

    def scored(batches):
        for b in slices(batches, text_col):
            col = b.column(b.schema.get_field_index(text_col))
            rows, at = model.known(col)
            z = model.margin(rows, at, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(z))], fields)

    return docs.mapInArrow(scored, StructType([*docs.schema, StructField(score_col, DoubleType())]))
