"""Language identification by a byte convolutional network in numpy.

A text's bytes are folded (letters lower-cased, everything that is not a
letter becomes one space) and cut into fixed windows. Each window goes through
a byte embedding, convolutions of several widths, ReLU, max pooling and a
softmax over the languages learned; a text's distribution is the mean over its
windows, weighted by their letters, so every byte of the text counts.

Training is Adam on windows of a bounded sample of labelled rows. Scoring runs
in Arrow batches, ``CHUNK`` windows at a time, so memory does not depend on
text lengths. The model is a few KB and travels in the task closure.

Defined cases: a null text or one without a letter (``\\p{L}``) gives ``und``
with score 0; without a labelled row every text gives ``und`` and 0; rows with a
null label are not learned from; repeated rows are predicted alike; other
columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .base import LETTER, LOWER, slices, staged, utf8

WINDOW = 192
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 6, 16
CHUNK = 1024


def _windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, letters in each) of the folded texts."""
    data, off = utf8(col)
    letter = LETTER[data]
    low = LOWER[data]
    if len(data):       # capital Latin-1 letters: C3 80..9E become C3 A0..BE
        cap = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
        cap[1:] &= data[:-1] == 0xC3
        cap[0] = False
        low = np.where(cap, low + 32, low).astype(np.uint8)
    keep = letter.copy()
    keep[1:] |= letter[:-1]                       # one space after a letter run
    low = np.where(letter, low, 32).astype(np.uint8)[keep]
    run = np.concatenate([[0], np.cumsum(keep)])
    first = run[off]
    size = np.diff(first)
    count = -(-size // WINDOW)
    rows = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][rows] + nth * WINDOW
    held = np.minimum(WINDOW, first[1:][rows] - start)
    at = start[:, None] + np.arange(WINDOW)
    out = np.where(np.arange(WINDOW) < held[:, None],
                   low[np.minimum(at, max(len(low) - 1, 0))] if len(low) else 32, 32)
    return out.astype(np.uint8), rows, (out != 32).sum(1)


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    conv: list = field(default_factory=list)     # per width (width * EMBED, FILTERS)
    bias: list = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, *self.bias, self.out, self.out_bias]

    def pooled(self, win: np.ndarray):
        """Max over positions of each filter, and the positions."""
        n = len(win)
        e = self.embed[win].reshape(n, WINDOW * EMBED)
        top, at = [], []
        for w, c, b in zip(WIDTHS, self.conv, self.bias):
            p = WINDOW - w + 1
            x = np.lib.stride_tricks.as_strided(
                e, (n, p, w * EMBED), (e.strides[0], EMBED * e.itemsize, e.itemsize))
            z = x.reshape(n * p, w * EMBED) @ c
            z = z.reshape(n, p, FILTERS)
            i = z.argmax(1)
            at.append(i)
            top.append(np.take_along_axis(z, i[:, None, :], 1)[:, 0] + b)
        return np.concatenate(top, 1), at

    def probs(self, win: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(win), CHUNK):
            e = self.embed[win[lo:lo + CHUNK]]
            n = len(e)
            e = e.reshape(n, WINDOW * EMBED)
            top = []
            for w, c, b in zip(WIDTHS, self.conv, self.bias):
                p = WINDOW - w + 1
                x = np.lib.stride_tricks.as_strided(
                    e, (n, p, w * EMBED), (e.strides[0], EMBED * e.itemsize, e.itemsize))
                z = x.reshape(n * p, w * EMBED) @ c
                top.append(z.reshape(n, p, FILTERS).max(1) + b)
            out.append(_softmax(np.maximum(np.concatenate(top, 1), 0) @ self.out + self.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(win: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64,
          rate: float = 4e-3, seed: int = 11) -> Net:
    """Adam on the cross-entropy of windows, classes weighted by rarity."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(langs, rng.normal(0, 0.5, (256, EMBED)).astype(f32))
    for w in WIDTHS:
        net.conv.append(rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(f32))
        net.bias.append(np.zeros(FILTERS, f32))
    wide = FILTERS * len(WIDTHS)
    net.out = rng.normal(0, wide ** -0.5, (wide, len(langs))).astype(f32)
    net.out_bias = np.zeros(len(langs), f32)
    count = np.bincount(y, minlength=len(langs))
    weight = (len(y) / np.maximum(count, 1) / len(langs)).astype(f32)
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            x, n = win[pick], len(pick)
            top, at = net.pooled(x)
            act = np.maximum(top, 0)
            g = _softmax(act @ net.out + net.out_bias)
            g[np.arange(n), y[pick]] -= 1
            g *= (weight[y[pick]] / n)[:, None]
            back = (g @ net.out.T) * (top > 0)
            grads = [np.zeros_like(net.embed)]
            gconv, gbias = [], []
            for k, w in enumerate(WIDTHS):
                d = back[:, k * FILTERS:(k + 1) * FILTERS]
                pos = at[k][:, :, None] + np.arange(w)                 # (n, filters, width)
                byte = x[np.arange(n)[:, None, None], pos]
                e = net.embed[byte].reshape(n, FILTERS, w * EMBED)
                gconv.append(np.einsum("nf,nfe->ef", d, e))
                gbias.append(d.sum(0))
                back_e = d[:, :, None] * net.conv[k].T[None]            # (n, filters, w*EMBED)
                np.add.at(grads[0], byte.ravel(), back_e.reshape(-1, EMBED))
            grads += [*gconv, *gbias, act.T @ g, g.sum(0)]
            step += 1
            for i, (p, q) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                p -= (rate * (m[i] / (1 - 0.9 ** step))
                      / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)).astype(f32)
    return net


def fit(docs: DataFrame, bound: int = 6000, per_text: int = 4, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Net:
    """Train on ``per_text`` windows, evenly spread, of at most ``bound`` rows:
    those with the smallest hash of the id among rows with a language."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = named.select(F.col(id_col).alias("id")).distinct() \
        .orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = staged(named.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                               F.col(lang_col).alias("lang"))
                  .where("text IS NOT NULL").join(F.broadcast(ids), "id"), "langid-sample")

    def cut(batches):
        for b in slices(batches, "text"):
            win, row, held = _windows(b.column("text"))
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            some = np.flatnonzero(np.diff(first))
            nth = (np.arange(per_text) + 0.5) / per_text
            at = np.unique((first[some][:, None]
                            + (nth * np.diff(first)[some][:, None]).astype(np.int64)).ravel())
            at = at[held[at] >= 8]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row[at])), b.column("lang").take(pa.array(row[at])),
                 pa.array([win[i].tobytes() for i in at], pa.binary())], ["id", "lang", "w"])

    s = rows.mapInArrow(cut, "id long, lang string, w binary").toPandas() \
        .sort_values(["id", "lang", "w"], kind="stable").drop_duplicates("w")
    langs = sorted(s["lang"].unique())
    win = np.frombuffer(b"".join(s["w"]), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(langs), s["lang"].to_numpy()) if len(langs) else np.zeros(0, int)
    if not langs:
        return Net([], np.zeros((256, EMBED), np.float32))
    return train(win, y, langs)


def predict(docs: DataFrame, net: Net, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its mean probability; columns
    of those names are replaced."""
    docs = docs.drop(lang_col, score_col)
    rows = docs.withColumn("__letters", F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))
    fields = [*docs.columns, lang_col, score_col]
    names = np.array([*net.langs, "und"], object)

    def scored(batches):
        for b in slices(batches, text_col, 1 << 20):
            n = b.num_rows
            some = b.column("__letters").to_numpy(zero_copy_only=False) & bool(net.langs)
            best, score = np.full(n, len(net.langs)), np.zeros(n)
            if some.any():
                win, row, held = _windows(b.column(b.schema.get_field_index(text_col)))
                p = net.probs(win) * held[:, None]
                total = np.maximum(np.bincount(row, held, n), 1e-9)
                mean = np.stack([np.bincount(row, p[:, k], n)
                                 for k in range(len(net.langs))], 1) / total[:, None]
                best = np.where(some, mean.argmax(1), best)
                score = np.where(some, np.clip(mean.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], fields)

    return rows.mapInArrow(scored, StructType([*docs.schema, StructField(lang_col, StringType()),
                                               StructField(score_col, DoubleType())]))
