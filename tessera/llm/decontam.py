"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``PASSAGE`` words of all documents give document frequencies of
   hashed terms (one pass, a sum per term).
2. A distributed randomised SVD of the TF-IDF passages: each task adds up
   A'(A Omega) over its passages, one aggregate sums the rows, and the driver
   takes the leading right singular vectors from the small product (single-pass
   Nystrom form). Its size is TERMS x (RANK + COMMON + 4), whatever the corpus.
   The ``COMMON`` strongest directions, which all passages share, are left out.
3. Every document's windows of 16, 32, 64, ... words are projected, half a
   window apart, and compared with the items of about that length: candidates
   have a cosine of at least ``cosine`` and hold enough of the item's weight.
4. A candidate is confirmed on the words around the window by the longest common
   subsequence: it must hold ``share`` of the item's words and of their idf
   weight, within a span not much longer than the item. Below ``CLOSE`` it must
   also hold half the weight of the item's answer, its last quarter (items have
   no answer column). Items longer than ``PASSAGE`` are also sought by their
   passages of that length, half a passage apart; one confirmed by ``CLOSE`` of
   its words and weight is a hit.
5. Verbatim parts are no matter of likeness: an item is hit by every text that
   holds ``RUN`` of its words in a row, or all of them if it has fewer, found by
   hashes of word runs. Items with fewer than ``least`` words are hit by that alone.

A word is a run of letters and digits; in scripts written without spaces
(Chinese, Japanese, Thai, ...) it is one character.

Benchmark items are the stated query set, taken ``ITEMS`` at a time; each block
is one scan of the documents, without a shuffle.

Defined cases: null texts and texts without words hit nothing; items without
words, or null, are never hit; an item of one word is hit by every text with that
word; the cosine is null where an item was found by word runs alone; ``lcs`` and
``answer`` are those of the item's common subsequence, or of the words in common
runs and passages if the item as a whole is not confirmed; repeated items each hit; repeated rows hit alike; a row with a null id
is searched and reported with it; empty tables give empty results; other columns
are kept by ``clean`` and not read by ``hits``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from .base import LETTER, Words, run_hashes, slices, staged

TERMS, RANK, COMMON = 4096, 64, 8
PASSAGE, BLOCK = 128, 8
ITEMS = 4096
CELLS = 1 << 22                  # of an alignment table built as a whole
CLOSE = 0.75
RUN = 13                         # words in a row that are a copy by themselves
_WORD = LETTER.copy()
_WORD[48:58] = True
#: First and last code points of scripts written without spaces, and of their
#: punctuation, which parts words as ASCII punctuation does.
_UNSPACED = [(0x0E01, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF),
             (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FFF), (0x3005, 0x3007),
             (0x3021, 0x312F), (0x31A0, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9DF),
             (0xAA00, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
_GAPS = [(0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20),
         (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _within(code: np.ndarray, ranges: list) -> np.ndarray:
    return np.searchsorted([r[0] for r in ranges], code, "right") > \
        np.searchsorted([r[1] for r in ranges], code, "left")


class ItemWords(Words):
    """Words of letters and digits, and single characters of unspaced scripts."""

    def __init__(self, col: pa.Array):
        super().__init__(col, _WORD)
        at = np.flatnonzero(self.data >= 0xE0)
        if not len(at):
            return
        size = np.where(self.data[at] >= 0xF0, 4, 3)
        b = self.data[np.minimum(at[:, None] + np.arange(4), len(self.data) - 1)].astype(np.int64)
        low = b & 63
        code = np.where(size == 3, (b[:, 0] & 15) << 12 | low[:, 1] << 6 | low[:, 2],
                        (b[:, 0] & 7) << 18 | low[:, 1] << 12 | low[:, 2] << 6 | low[:, 3])
        gap = _within(code, _GAPS)
        cut = gap | _within(code, _UNSPACED)
        # a character stands within the bytes of one word, which it parts
        at, to = at[cut], (at + size)[cut]
        start = np.unique(np.concatenate([self.start, at, np.setdiff1d(to, self.end)]))
        end = np.unique(np.concatenate([self.end, to, np.setdiff1d(at, self.start)]))
        kept = ~np.isin(start, at[gap[cut]])
        self.start, self.end = start[kept], end[kept]
        self.first = np.searchsorted(self.start, self.off)


def _terms(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


def _blocks(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and row of the consecutive blocks of ``size`` words."""
    n = np.diff(first)
    count = -(-n // size)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][row] + nth * size, row


# --- statistics of all documents ------------------------------------------------

def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    def counted(batches):
        total, passages = np.zeros(TERMS, np.int64), 0
        for b in slices(batches, "text"):
            w = ItemWords(b.column("text"))
            start, _ = _blocks(w.first, PASSAGE)
            if len(start):
                p = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w.start))))
                at = np.sort(p * TERMS + _terms(w.hashes()))
                at = at[np.diff(at, prepend=-1) != 0]
                total += np.bincount(at % TERMS, minlength=TERMS)
                passages += len(start)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(TERMS), -1)), pa.array(np.append(total, passages))],
            ["t", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "t long, n long") \
        .groupBy("t").agg(F.sum("n").alias("n")).collect()          # TERMS + 1 rows
    df, n = np.zeros(TERMS), 0
    for r in rows:
        if r["t"] < 0:
            n = r["n"]
        else:
            df[r["t"]] = r["n"]
    return np.log((n + 1) / (df + 0.5)).clip(0.05).astype(np.float32)


def latent_space(docs: DataFrame, idf: np.ndarray, text_col: str = "text",
                 seed: int = 17) -> np.ndarray:
    """(TERMS, RANK) singular directions of the TF-IDF passages over their
    singular values: in these coordinates unlike passages are nearly
    orthogonal, whatever common words they share."""
    wide = RANK + COMMON + 4
    omega = np.random.default_rng(seed).normal(size=(TERMS, wide)).astype(np.float32)

    def summed(batches):
        scaled, total = omega * idf[:, None], np.zeros((TERMS, wide))
        for b in slices(batches, "text", 1 << 20):
            w = ItemWords(b.column("text"))
            t = _terms(w.hashes())
            start, _ = _blocks(w.first, PASSAGE)
            for lo in range(0, len(start), 256):
                s = start[lo:lo + 256]
                end = start[lo + 256] if lo + 256 < len(start) else len(t)
                p = np.repeat(np.arange(len(s)), np.diff(np.append(s, end)))
                a = np.bincount(p * TERMS + t[s[0]:end], minlength=len(s) * TERMS) \
                    .reshape(len(s), TERMS).astype(np.float32)
                total += a.T @ (a @ scaled)
        total *= idf[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(TERMS)), *(pa.array(c) for c in total.T)],
            ["t", *(f"c{k}" for k in range(wide))])

    cols = [f"c{k}" for k in range(wide)]
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(
        summed, "t long, " + ", ".join(f"{c} double" for c in cols)) \
        .groupBy("t").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()   # TERMS rows
    y = np.zeros((TERMS, wide))
    if len(rows):
        y[rows["t"]] = rows[cols].to_numpy()
    # Nystrom: with Y = G Omega and G = A'A, G ~ Y (Omega'Y)^-1 Y'
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T.astype(float) @ y
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core)
    half = vec / np.sqrt(np.maximum(val, 1e-12 * max(val.max(), 1e-12)))
    u, size, _ = np.linalg.svd(y @ half, full_matrices=False)
    return (u / np.maximum(size, 1e-9 * max(size[0], 1e-9)))[:, COMMON:COMMON + RANK] \
        .astype(np.float32)


# --- search -------------------------------------------------------------------------

class Runs:
    """Index of runs of words of the items: where does one stand in a text?"""

    def __init__(self, words: list, runs: list[tuple[int, int]]):
        """``runs``: (item, words of a run); every run of that size is indexed."""
        self.sizes = []                  # size, filter, hashes, their runs: item, first word
        for n in sorted({n for _, n in runs}):
            item = [k for k, m in runs if m == n]
            h = [run_hashes(words[k], n) for k in item]
            item = np.repeat(np.array(item), [len(x) for x in h])
            at = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            o = np.argsort(h, kind="stable")
            keys, first = np.unique(h[o], return_index=True)
            near = np.zeros(1 << int(16 * len(keys)).bit_length(), bool)
            near[(keys & np.uint64(len(near) - 1)).astype(np.int64)] = True
            self.sizes.append((n, near, keys, np.append(first, len(o)), item[o], at[o]))

    def found(self, w: Words, h: np.ndarray):
        """(row, item, first word in the item, size) of the indexed runs in each
        row, each once."""
        if not self.sizes or not len(h):
            return
        row = w.rows()
        for n, near, keys, first, item, at in self.sizes:
            r = run_hashes(h, n)
            x = np.flatnonzero(near[(r & np.uint64(len(near) - 1)).astype(np.int64)])
            x = x[x + n <= w.first[row[x] + 1]]
            k = np.minimum(np.searchsorted(keys, r[x]), len(keys) - 1)
            same = keys[k] == r[x]
            both = np.unique(row[x[same]] * len(keys) + k[same])
            for i, k in zip((both // len(keys)).tolist(), (both % len(keys)).tolist()):
                for e in range(first[k], first[k + 1]):
                    yield i, int(item[e]), int(at[e]), n


@dataclass
class Queries:
    """A block of benchmark items against the latent space."""
    ids: list
    words: list                      # word hashes of each item
    idf: np.ndarray
    space: np.ndarray
    cosine: float
    share: float
    least: int
    latent: np.ndarray = field(init=False)

    def __post_init__(self):
        self.scaled = self.space * self.idf[:, None]
        self.padded = np.concatenate([self.scaled, np.zeros((1, RANK), np.float32)])
        self.runs = Runs(self.words, [(k, min(len(w), RUN)) for k, w in enumerate(self.words)])
        # what is sought in the latent space: items, and passages of long items
        self.units = [(k, lo, to) for k, w in enumerate(self.words) if len(w) >= self.least
                      for lo, to in _passages(len(w))]
        words = [self.words[k][lo:to] for k, lo, to in self.units]
        self.latent = _unit(np.stack([self.scaled[_terms(w)].sum(0) for w in words])) \
            if words else np.zeros((0, RANK), np.float32)
        self.has = np.zeros((len(words), TERMS), bool)
        for k, w in enumerate(words):
            self.has[k, _terms(w)] = True
        self.weight = np.array([self.idf[_terms(w)].sum() for w in words])
        # each is sought in windows of the width nearest its length
        size = np.array([len(w) for w in words], float)
        self.width = 2 ** np.clip(np.round(np.log2(np.maximum(size, 1))), 4, None).astype(int)

    def candidates(self, w: Words, t: np.ndarray):
        """(row, unit, first word, end word, cosine) of the windows near a
        unit that hold enough of its idf weight for a hit."""
        start, row = _blocks(w.first, BLOCK)
        if not len(start) or not len(self.latent):
            return
        # the words of each block, the zero row after the last
        at = start[:, None] + np.arange(BLOCK)
        ends = np.append(start[1:], len(t))
        at = np.where(at < ends[:, None], t[np.minimum(at, len(t) - 1)], TERMS)
        sums = self.padded[at[:, 0]]
        for k in range(1, BLOCK):
            sums += self.padded[at[:, k]]
        # running sums around the mean stay small enough for 32 bits
        mean = sums.mean(0)
        run = np.zeros((len(sums) + 1, RANK), np.float32)
        np.cumsum(sums - mean, 0, out=run[1:])
        last = np.searchsorted(row, row, "right")           # end block of each block's row
        nth = np.arange(len(start)) - np.searchsorted(row, row, "left")
        ends = np.append(start, len(t))
        weight = self.idf[t]
        for width in np.unique(self.width):
            of = np.flatnonzero(self.width == width)
            latent = self.latent[of].T
            k, step = width // BLOCK, max(1, width // BLOCK // 2)
            at = np.flatnonzero((nth % step == 0)
                                & ((nth == 0) | (last - np.arange(len(start)) > k - step)))
            to = np.minimum(at + k, last[at])
            for lo in range(0, len(at), 4096):
                a, e = at[lo:lo + 4096], to[lo:lo + 4096]
                c = _unit(run[e] - run[a] + (e - a)[:, None].astype(np.float32) * mean) @ latent
                i, j = np.nonzero(c >= self.cosine)
                if not len(i):
                    continue
                near, j = c[i, j], of[j]
                s, n = start[a[i]], ends[e[i]] - start[a[i]]
                pair = np.repeat(np.arange(len(i)), n)
                word = np.repeat(s - np.cumsum(n) + n, n) + np.arange(len(pair))
                held = np.bincount(pair, weight[word] * self.has[j[pair], t[word]], len(i))
                # a window misses at most part of an item that lies across two
                for x in np.flatnonzero(held >= 0.6 * self.share * self.weight[j]):
                    yield (int(row[a[i[x]]]), int(j[x]), int(s[x]), int(s[x] + n[x]),
                           float(near[x]))

    def confirmed(self, col: pa.Array):
        """(row, item, cosine, lcs, answer) of the confirmed hits, each pair once."""
        w = ItemWords(col)
        h = w.hashes()
        near: dict = {}
        done: set = set()
        whole: dict = {}                 # (row, item): words of the item that were found
        parts: dict = {}
        for row, u, lo, hi, c in self.candidates(w, _terms(h)):
            j, at, to = self.units[u]
            if (row, u) in done:
                near[row, j] = max(near[row, j], c)
                continue
            q = self.words[j][at:to]
            pad = len(q)
            text = h[max(lo - pad, w.first[row]):min(hi + pad, w.first[row + 1])]
            full = len(q) == len(self.words[j])
            if np.isin(q, text).mean() >= self.share and \
                    (got := self._confirm(q, text, full)) is not None:
                done.add((row, u))
                near[row, j] = max(near.get((row, j), c), c)
                if full:
                    whole[row, j] = got
                else:
                    parts.setdefault((row, j), np.zeros(len(self.words[j]), bool))[at:to] |= got
        for row, j, at, n in self.runs.found(w, h):
            parts.setdefault((row, j), np.zeros(len(self.words[j]), bool))[at:at + n] = True
        for (row, j), got in sorted((parts | whole).items(), key=lambda x: x[0]):
            yield (row, j, near.get((row, j)), float(got.mean()), self._answer(self.words[j], got))

    def _answer(self, q: np.ndarray, held: np.ndarray) -> float:
        """Share of the weight of the answer that is held."""
        weight = self.idf[_terms(q)].astype(float)
        tail = max(len(q) - max(len(q) // 4, 2), 0)
        return float(weight[tail:][held[tail:]].sum() / weight[tail:].sum())

    def _confirm(self, q: np.ndarray, text: np.ndarray, full: bool):
        """The words held of an item, or (not ``full``) of a passage of it, if
        it is in the text, else None."""
        at = _common_subsequence(q, text, int(1.6 * len(q)) + 4)
        if len(at) < self.share * len(q):
            return None
        weight = self.idf[_terms(q)].astype(float)
        held = np.zeros(len(q), bool)
        held[at] = True
        share = min(len(at) / len(q), weight[held].sum() / weight.sum())
        if share < self.share or share < CLOSE and (
                not full or self._answer(q, held) < 0.5):
            return None
        return held


def _passages(n: int) -> list[tuple[int, int]]:
    """First and end word of an item of ``n`` words, and of its passages."""
    if n <= PASSAGE:
        return [(0, n)]
    starts = [*range(0, n - PASSAGE, PASSAGE // 2), n - PASSAGE]
    return [(0, n), *((lo, lo + PASSAGE) for lo in starts)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _common_subsequence(q: np.ndarray, text: np.ndarray, span: int) -> np.ndarray:
    """Words of ``q`` (indices) in its longest common subsequence with the
    stretch of ``span`` words of ``text`` that shares most words with it."""
    if len(text) > span:
        hit = np.concatenate([[0], np.cumsum(np.isin(text, q))])
        lo = int((hit[span:] - hit[:-span]).argmax())
        text = text[lo:lo + span]
    return _aligned(q, text)


def _lengths(q: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of ``q`` and all prefixes of ``text``."""
    best = np.zeros(len(text) + 1, np.int32)
    for word in q:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (text == word)))
    return best


def _aligned(q: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words of ``q`` (indices) in a longest common subsequence. A table of more
    than ``CELLS`` cells is not built: both halves of ``q`` are aligned with the
    parts of the text where their lengths add up to the most."""
    m, n = len(q), len(text)
    if m > 1 and m * n > CELLS:
        h = m // 2
        k = int((_lengths(q[:h], text) + _lengths(q[h:][::-1], text[::-1])[::-1]).argmax())
        return np.concatenate([_aligned(q[:h], text[:k]), h + _aligned(q[h:], text[k:])])
    best = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m):
        best[i + 1, 1:] = np.maximum.accumulate(
            np.maximum(best[i, 1:], best[i, :-1] + (q[i] == text)))
    out, i, j = [], m, n
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return np.array(out[::-1], np.int64)


def query_blocks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35,
                 share: float = 0.6, least: int = 8, text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> Iterator[Queries]:
    """Fit on all documents; the items in blocks of ``ITEMS``, made one after
    the other (at least one block, if an empty one)."""
    idf = inverse_frequencies(docs, text_col)
    space = latent_space(docs, idf, text_col)
    ids, words, any_block = [], [], False
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")) \
            .where("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        h = ItemWords(pa.array([r["t"]])).hashes()
        if len(ids) == ITEMS:
            yield Queries(ids, words, idf, space, cosine, share, least)
            ids, words, any_block = [], [], True
        if len(h):
            ids.append(r["i"]), words.append(h)
    if ids or not any_block:
        yield Queries(ids, words, idf, space, cosine, share, least)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", **kw) -> DataFrame:
    """One row per (document, benchmark item) confirmed: id_col, item_col (their
    types kept), cosine, lcs (share of the item's words), answer (share of its
    weight). One scan per block of items, whose closure holds that block
    alone; the hits of more than one block are staged as they come."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType),
        StructField(item_col, benchmark.schema[item_col].dataType),
        *(StructField(c, DoubleType()) for c in ("cosine", "lcs", "answer"))])

    def scan(q: Queries) -> DataFrame:
        def searched(batches):
            kind = to_arrow_type(schema[1].dataType)
            for b in slices(batches, "text", 2 << 20):
                ids = b.column("id")
                found = list(q.confirmed(b.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([f[0] for f in found], pa.int64())),
                     pa.array([q.ids[f[1]] for f in found], kind),
                     *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))],
                    schema.names)
        return rows.mapInArrow(searched, schema)

    out, last = None, None
    for q in query_blocks(docs, benchmark, text_col=text_col, item_col=item_col, **kw):
        if last is not None:
            part = staged(scan(last), "decontam-hits")
            out = part if out is None else out.unionAll(part)
        last = q
    return scan(last) if out is None else out.unionAll(staged(scan(last), "decontam-hits"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that hit a benchmark item, all columns kept:
    one pass per block of items over what the blocks before have left."""
    def scan(left: DataFrame, q: Queries) -> DataFrame:
        def kept(batches):
            for b in slices(batches, text_col, 2 << 20):
                keep = np.ones(b.num_rows, bool)
                for f in q.confirmed(b.column(b.schema.get_field_index(text_col))):
                    keep[f[0]] = False
                yield b.filter(pa.array(keep))
        return left.mapInArrow(kept, left.schema)

    left, last = docs, None
    for q in query_blocks(docs, benchmark, text_col=text_col, **kw):
        if last is not None:
            left = staged(scan(left, last), "decontam-left")
        last = q
    return scan(left, last)
