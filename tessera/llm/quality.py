"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text becomes a fixed row of statistics (lengths, shares of character
classes, word and line repetition), computed in numpy on the Arrow bytes of
whole texts. Trees of fixed depth are grown on binned features of a bounded
labelled sample with the logistic loss, and flattened into one array per field
(feature, threshold, value; node i has children 2i+1, 2i+2), so a batch goes
down all trees by vectorised indexing.

Defined cases: null counts as empty; an empty text has all-zero statistics and
is scored like any other; without labels of both classes every score is the
smoothed share of label 1; repeated rows are scored alike; other columns are
neither used nor needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .base import LETTER, Words, mix, slices, span_hashes, utf8
from .labelled import labelled_sample
from .toxicity import sigmoid

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
            "wide": range(128, 256), "space": b" ", "newline": b"\n", "bang": b"!?",
            "stop": b".,;:", "bar": b"|", "symbol": b"#$%&*+=<>^~@_", "bracket": b"(){}[]\\/",
            "quote": b"\"'`", "dash": b"-"}


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return run[first[1:]] - run[first[:-1]]


def _repeats(rows: np.ndarray, h: np.ndarray, size: np.ndarray, n: int):
    """Share of distinct items, and of the commonest item, in each row."""
    o = np.lexsort((h, rows))
    r, v = rows[o], h[o]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], runs)
    size = np.maximum(size, 1)
    return np.bincount(r[at], minlength=n) / size, top / size


def statistics(col: pa.Array) -> np.ndarray:
    """(rows, features) statistics of whole texts."""
    raw, off = utf8(col)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    some = np.maximum(size, 1)
    out = [np.log1p(size)]
    for c in _CLASSES.values():
        t = np.zeros(256, bool)
        t[list(c)] = True
        out.append(_per_row(t[raw], off) / some)
    letters = np.maximum((out[1] + out[2] + out[4]) * some, 1)
    out.append(out[1] * some / letters)                       # capitals among letters
    w = Words(col)
    length = (w.end - w.start).astype(float)
    words = np.diff(w.first).astype(float)
    per = np.maximum(words, 1)
    out += [np.log1p(words), _per_row(length, w.first) / per]
    out.append(np.sqrt(np.maximum(_per_row(length ** 2, w.first) / per - out[-1] ** 2, 0)))
    out += [_per_row(length <= 2, w.first) / per, _per_row(length > 20, w.first) / per]
    alpha = np.concatenate([[0], np.cumsum(LETTER[w.data])])
    letter = alpha[w.end] - alpha[w.start]
    out += [_per_row(letter == 0, w.first) / per, _per_row(letter == length, w.first) / per]
    rows, h = w.rows(), w.hashes()
    out += _repeats(rows, h, words, n)
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    inside = rows[:-1] == rows[1:] if len(h) else np.zeros(0, bool)
    out += _repeats(rows[:-1][inside], pair[inside], words - 1, n)
    solid = np.ones(256, bool)
    solid[10] = False
    lines = Words(col, solid)                                   # runs without newline
    count = np.diff(lines.first).astype(float)
    out += [np.log1p(count), _per_row((lines.end - lines.start), lines.first)
            / np.maximum(count, 1)]
    out += _repeats(lines.rows(), span_hashes(lines.data, lines.start, lines.end), count, n)
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    out.append(_per_row(same, off) / some)                      # a byte equal to the last
    return np.stack(out, 1)


@dataclass
class Trees:
    base: float
    feature: np.ndarray      # (trees, inner nodes)
    threshold: np.ndarray    # (trees, inner nodes): right if x > threshold
    value: np.ndarray        # (trees, leaves)
    depth: int
    rows: int = 0            # of the sample

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        at0 = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at0, f[node]] > t[node])
            z += v[node - (2 ** self.depth - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 120,
          depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 1.0,
          min_weight: float = 2.0) -> Trees:
    """Grow ``trees`` level-wise trees on quantile-binned features."""
    n, k = x.shape
    weight = np.ones(n) if weight is None else weight
    share = (weight @ y + 0.5) / (weight.sum() + 1)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    out = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64),
                np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    if not n or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    cuts = [c[c < x[:, f].max()] if len(np.unique(x[:, f])) > 2 else x[:, f].min(keepdims=True)
            if x[:, f].min() < x[:, f].max() else c[:0] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    z = np.full(n, out.base)
    feats, thrs, vals = [], [], []
    for _ in range(trees):
        p = sigmoid(z)
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feat, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, start = 2 ** level, 2 ** level - 1
            local = node - start
            best = np.full(width, 1e-6)
            cut = np.zeros(width, np.int64)
            for f in range(k):
                own = len(cuts[f]) + 1
                if own == 1:
                    continue
                key = local * own + binned[f]
                gl = np.bincount(key, g, width * own).reshape(width, own).cumsum(1)
                hl = np.bincount(key, h, width * own).reshape(width, own).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(hl < min_weight * 0.05) | (ht - hl < min_weight * 0.05)] = 0
                gain[:, -1] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                won = top > best
                best[won], cut[won] = top[won], b[won]
                feat[start:start + width][won] = f
                thr[start:start + width][won] = cuts[f][b[won]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        z += value[leaf]
        feats.append(feat), thrs.append(thr), vals.append(value)
    out.feature, out.threshold, out.value = np.stack(feats), np.stack(thrs), np.stack(vals)
    return out


def _stats(batches):
    for b in slices(batches, "text"):
        x = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("y").cast(pa.int64()),
             pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
             .cast(pa.list_(pa.float64()))], ["id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 20_000,
        id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Train on at most ``bound`` rows of ``labels`` (id_col, label)."""
    sample = labelled_sample(docs, labels, label, bound, id_col, text_col)
    schema = StructType([sample.schema["id"], StructField("y", LongType()),
                         StructField("x", ArrayType(DoubleType()))])
    s = sample.mapInArrow(_stats, schema).toPandas().sort_values(["id", "y"], kind="stable")
    width = statistics(pa.array([""])).shape[1]
    x = np.stack(s["x"].to_numpy()) if len(s) else np.zeros((0, width))
    model = boost(x, s["y"].to_numpy(float))
    model.rows = len(s)                                  # of the sample
    return model


def score(docs: DataFrame, model: Trees, text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) appended; all columns are kept, but
    one of that name is replaced."""
    docs = docs.drop(score_col)
    fields = [*docs.schema.names, score_col]

    def scored(batches):
        for b in slices(batches, text_col):
            x = statistics(b.column(b.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sigmoid(model.margin(x)))], fields)

    return docs.mapInArrow(scored, StructType([*docs.schema, StructField(score_col, DoubleType())]))
