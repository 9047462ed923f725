"""Ranked lexical search by K2-treaps over the grid of terms and documents.

A task indexes its documents in blocks (``BLOCK_DOCS`` documents or
``BLOCK_CELLS`` cells). A block is a square grid, a power of two wide: a row per
term, frequent ones first, a column per document by ascending id, and in the
cell of a term in a document its impact

    (10^9 tf) div (1000 tf + 12 m),   m = 75 + (25 n N) div L

(n terms in the document, L in all N documents that have any). The grid is a
quadtree: every node holds a mask of its non-empty quadrants and the maximum
impact below it. Nodes stand in breadth-first order, so the children of a node
begin at the number of quadrants marked before it. Stored are the masks, two to
a byte, and the differences of maxima from parent to child, both compressed.

An item descends a block with the row paths of all its terms together. An entry
of its frontier is a range of documents with one node per term that occurs in
it; the sum of weight times maximum bounds the scores in the range, and is the
score where the range is one document. Each round opens the best ``BREADTH``
entries of every item; entries that cannot enter the best k met by the task are
dropped. Ties go by document id: columns ascend by id, so a range that can only
equal the k-th score counts while its first id is smaller. The result is exact.

Every document is indexed, with all its terms. Items are taken in blocks of
``ITEMS`` items or ``ITEM_BYTES`` of text, one scan of the index each; the
closure of a scan holds the terms and weights of one block of items.

Cases: null texts and texts without terms are no documents (they count in
neither N nor L); repeated rows are documents of their own; ids are integers, a
null id comes after all others in a tie; items without terms, or whose terms
score nowhere, have no rows; items that repeat are ranked each; empty tables
give an empty result. Texts of any length are read whole, in pieces of ``CHUNK``
bytes. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOWER, slices, span_hashes, staged, utf8
from .bpe import spread

BLOCK_DOCS = 1 << 12
BLOCK_CELLS = 1 << 21
CHUNK = 1 << 20
BREADTH = 64
SLOTS = 1 << 10
ITEMS = 1 << 11
ITEM_BYTES = 4 << 20
#: Bytes of terms: digits, letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)


# --- terms ---------------------------------------------------------------------

def terms(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all terms of a text column, in pieces that end between
    terms."""
    data, off = utf8(col)
    n, at = len(data), 0
    while at < n:
        to = min(at + CHUNK, n)
        if to < n:
            gap = np.flatnonzero(~TERM[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                edge = int(off[np.searchsorted(off, at, "right")])
                gap = np.flatnonzero(~TERM[data[to:edge]])
                to = max(to, at + 1) + int(gap[0]) if len(gap) else edge
        piece = LOWER[data[at:to]]
        solid = TERM[piece]
        edges = off[np.searchsorted(off, at):np.searchsorted(off, to)] - at
        border = np.zeros(len(piece) + 1, bool)
        border[edges] = True
        border[-1] = True
        before = np.append(False, solid[:-1]) & ~border[:-1]
        after = np.append(solid[1:], False) & ~border[1:]
        start, stop = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        yield np.searchsorted(off, start + at, "right") - 1, span_hashes(piece, start, stop)
        at = to


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- the tree ------------------------------------------------------------------

def _doubled(x: np.ndarray) -> np.ndarray:
    """A zero bit before every bit."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF),
                        (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x.astype(np.int64)


def build(row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int) -> bytes:
    """The stored tree of a grid's cells (each once, value > 0)."""
    code = _doubled(row) << 1 | _doubled(column)
    order = np.argsort(code)
    code, top = code[order], value[order].astype(np.int64)
    masks, drops = [], []
    for _ in range(height):
        parent = code >> 2
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        above = np.maximum.reduceat(top, first)
        masks.append(np.bitwise_or.reduceat(1 << (code & 3), first).astype(np.uint8))
        drops.append(np.repeat(above, np.diff(np.append(first, len(code)))) - top)
        code, top = parent[first], above
    mask = np.concatenate(masks[::-1])
    drop = np.concatenate([top, *drops[::-1]]).astype("<u4")
    if len(mask) % 2:
        mask = np.append(mask, np.uint8(0))
    packed = mask[::2] | mask[1::2] << 4
    data = packed.tobytes() + drop.view(np.uint8).reshape(-1, 4).T.tobytes()   # byte planes
    return np.array([len(drop), len(packed), len(data)], "<i8").tobytes() + \
        pa.compress(data, codec="zstd", asbytes=True)


class Tree:
    """A stored tree opened: ``mask``, first child and maximum of each node."""

    def __init__(self, blob: bytes, height: int):
        n, m, size = np.frombuffer(blob[:24], "<i8").tolist()
        data = np.frombuffer(pa.decompress(blob[24:], decompressed_size=size, codec="zstd"), np.uint8)
        self.height = height
        both = np.stack([data[:m] & 15, data[:m] >> 4], 1).ravel()
        drop = np.ascontiguousarray(data[m:].reshape(4, n).T).view("<u4").ravel()
        count = np.append(_BITS[both], 0)
        self.base = 1 + np.cumsum(count) - count
        self.mask = both
        self.top = drop.astype(np.int64)
        at, to = 0, 1
        for _ in range(height):
            nxt = to + int(count[at:to].sum())
            self.top[to:nxt] = np.repeat(self.top[at:to], count[at:to]) - self.top[to:nxt]
            at, to = to, nxt


class Best:
    """The k best (score, id) of each item so far, ties by id, nulls last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score, self.null, self.id = self.item, np.zeros(0, bool), self.item
        self.full = np.zeros(n, bool)
        self.least = np.zeros(n, np.int64)
        self.last_null, self.last_id = np.zeros(n, bool), np.zeros(n, np.int64)

    def may_enter(self, item, score, null, ident) -> np.ndarray:
        least = self.least[item]
        same = (score == least) & ((null < self.last_null[item]) | (
            (null == self.last_null[item]) & (ident < self.last_id[item])))
        return np.where(self.full[item], (score > least) | same, score > 0)

    def add(self, item, score, null, ident) -> None:
        item, score, null, ident = (np.concatenate(p) for p in (
            (self.item, item), (self.score, score), (self.null, null), (self.id, ident)))
        order = np.lexsort((ident, null, -score, item))
        item = item[order]
        order = order[_place(item) < self.k]
        self.item, self.score, self.null, self.id = _sorted(item, self.k), score[order], \
            null[order], ident[order]
        tail = np.flatnonzero(np.append(self.item[1:] != self.item[:-1], True)) \
            if len(self.item) else np.zeros(0, np.int64)
        held = np.bincount(self.item, minlength=len(self.full))
        self.full = held == self.k
        tail = tail[self.full[self.item[tail]]]
        where = self.item[tail]
        self.least[where], self.last_null[where], self.last_id[where] = \
            self.score[tail], self.null[tail], self.id[tail]


def _place(group: np.ndarray) -> np.ndarray:
    """Place of each entry in its run of equal values."""
    n = len(group)
    head = np.append(True, group[1:] != group[:-1])[:n]
    return np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))


def _sorted(item: np.ndarray, k: int) -> np.ndarray:
    return item[_place(item) < k]


def descend(tree: Tree, item: np.ndarray, row: np.ndarray, weight: np.ndarray,
            ids: np.ndarray, nulls: np.ndarray, best: Best) -> None:
    """Add to ``best`` what the items find in one block. ``item``, ``row`` and
    ``weight`` name the terms that the block has, sorted by item; ``ids`` and
    ``nulls`` are the columns'."""
    h = tree.height
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    # frontier: range (level, column), bound, and its run of the pool
    e_item, e_n = item[first], np.diff(np.append(first, len(item)))
    e_level = np.zeros(len(first), np.int64)
    e_column, e_at = np.zeros(len(first), np.int64), first.copy()
    e_bound = np.add.reduceat(weight * tree.top[0], first)
    pool_node, pool_slot = np.zeros(len(item), np.int32), np.arange(len(item), dtype=np.int32)
    used = len(item)
    while len(e_item):
        start = np.minimum(e_column << (h - e_level), len(ids) - 1)
        live = best.may_enter(e_item, e_bound, nulls[start], ids[start])
        e_item, e_n, e_level, e_column, e_at, e_bound = (
            x[live] for x in (e_item, e_n, e_level, e_column, e_at, e_bound))
        if not len(e_item):
            return
        order = np.lexsort((-e_bound, e_item))
        opened = np.zeros(len(order), bool)
        opened[order[_place(e_item[order]) < BREADTH]] = True
        o_item, o_n, o_level, o_column, o_at = (
            x[opened] for x in (e_item, e_n, e_level, e_column, e_at))
        e_item, e_n, e_level, e_column, e_at, e_bound = (
            x[~opened] for x in (e_item, e_n, e_level, e_column, e_at, e_bound))
        # both halves of each opened range, with the nodes of its terms there
        at = spread(o_at, o_n)
        node, slot = pool_node[at], pool_slot[at]
        entry = np.repeat(np.arange(len(o_n)), o_n)
        low = (row[slot] >> (h - 1 - o_level[entry]) & 1) * 2
        mask, base = tree.mask[node], tree.base[node]
        keys, nodes, slots = [], [], []
        for half in (0, 1):
            has = np.flatnonzero(mask >> (low + half) & 1)
            under = mask[has] & ((1 << (low[has] + half)) - 1)
            keys.append(entry[has] * 2 + half)
            nodes.append(base[has] + _BITS[under])
            slots.append(slot[has])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, node, slot = key[order], np.concatenate(nodes)[order], np.concatenate(slots)[order]
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        which = key[first]
        size = np.diff(np.append(first, len(key)))
        bound = np.add.reduceat(weight[slot] * tree.top[node], first)
        n_item, n_level = o_item[which >> 1], o_level[which >> 1] + 1
        n_column = o_column[which >> 1] * 2 + (which & 1)
        leaf = n_level == h
        if leaf.any():
            c = n_column[leaf]
            found = (n_item[leaf], bound[leaf], nulls[c], ids[c])
            good = best.may_enter(*found)
            if good.any():
                best.add(*(x[good] for x in found))
        more = ~leaf
        start = n_column[more] << (h - n_level[more])
        more[more] = best.may_enter(n_item[more], bound[more], nulls[start], ids[start])
        keep = np.repeat(more, size)
        grown = int(keep.sum())
        if used + grown > len(pool_node):
            room = np.zeros(max(used + grown, 2 * len(pool_node)) - len(pool_node), np.int32)
            pool_node, pool_slot = np.append(pool_node, room), np.append(pool_slot, room)
        pool_node[used:used + grown], pool_slot[used:used + grown] = node[keep], slot[keep]
        n_at = used + np.cumsum(size[more]) - size[more]
        used += grown
        e_item, e_n, e_level, e_column, e_at, e_bound = (np.concatenate(p) for p in (
            (e_item, n_item[more]), (e_n, size[more]), (e_level, n_level[more]),
            (e_column, n_column[more]), (e_at, n_at), (e_bound, bound[more])))


# --- the index -----------------------------------------------------------------

def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in slices(batches, "text"):
            count = np.zeros(b.num_rows, np.int64)
            data, off = utf8(b.column("text"))
            for at in range(0, len(data), CHUNK):
                solid = TERM[data[at:at + CHUNK + 1]]
                here = min(CHUNK, len(data) - at)
                # a term's last byte: the next one is none, or another row's
                last = solid[:here] & ~np.append(solid[1:], False)[:here]
                if at + here < len(data):
                    last[-1] = solid[here - 1] and not TERM[data[at + here]]
                ends = off[1:] - 1 - at
                ends = ends[(ends >= 0) & (ends < here)]
                last[ends] = solid[ends]
                at_end = np.flatnonzero(last) + at
                np.add.at(count, np.searchsorted(off, at_end, "right") - 1, 1)
            n += int((count > 0).sum())
            total += int(count.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n long, total long") \
        .agg(F.sum("n"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


class _Grid:
    """Postings of a task since the last written block."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.start()

    def start(self) -> None:
        self.ids, self.lengths, self.parts, self.cells, self.docs = [], [], [], 0, 0

    def add(self, b: pa.RecordBatch) -> None:
        length = np.zeros(b.num_rows, np.int64)
        for row, h in terms(b.column("text")):
            length += np.bincount(row, minlength=b.num_rows)
            term, at = np.unique(h, return_inverse=True)
            key, tf = np.unique(at << 32 | row, return_counts=True)
            self.parts.append((term[key >> 32], (key & 0xFFFFFFFF) + self.docs, tf))
            self.cells += len(key)
        self.ids.append(b.column("id"))
        self.lengths.append(length)
        self.docs += b.num_rows

    def block(self) -> pa.RecordBatch | None:
        if not self.cells:
            self.start()
            return None
        ids = pa.chunked_array(self.ids).combine_chunks()
        null = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0))
        order = np.lexsort((ids, null))
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        m = np.array([75 + (25 * n * self.n_docs) // self.n_terms
                      for n in np.concatenate(self.lengths).tolist()], np.int64)
        term, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        doc = np.concatenate([p[1] for p in self.parts])
        tf = np.concatenate([p[2] for p in self.parts])
        key = at << 32 | doc                        # a long text comes in pieces
        o = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[o][1:] != key[o][:-1]))
        at, doc, tf = at[o][first], doc[o][first], np.add.reduceat(tf[o], first)
        df = np.bincount(at)
        row = np.empty(len(term), np.int64)
        row[np.argsort(-df, kind="stable")] = np.arange(len(term))
        height = max(1, (max(len(term), len(ids)) - 1).bit_length())
        tree = build(row[at], column[doc], impacts(tf, m[doc]), height)
        out = [len(ids), height, ids[order].astype("<i8").tobytes(), null[order].tobytes(),
               term.astype("<u8").tobytes(), row.astype("<u4").tobytes(),
               df.astype("<u4").tobytes(), tree]
        self.start()
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in out],
            ["n", "height", "ids", "nulls", "terms", "rows", "df", "tree"])


def index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per block: its documents' ids, its terms (hashes, rows, document
    frequencies) and its tree. ``n_docs`` and ``n_terms`` are ``totals``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _Grid(n_docs, n_terms)
        for b in slices(batches, "text"):
            grid.add(b)
            if grid.docs >= BLOCK_DOCS or grid.cells >= BLOCK_CELLS:
                if (out := grid.block()) is not None:
                    yield out
        if (out := grid.block()) is not None:
            yield out

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "n int, height int, ids binary, nulls binary, terms binary, "
                         "rows binary, df binary, tree binary")


def document_counts(blocks: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the (sorted) term hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for t, d in zip(b.column("terms"), b.column("df")):
                have = np.frombuffer(t.as_py(), "<u8")
                _, i, j = np.intersect1d(wanted, have, assume_unique=True, return_indices=True)
                total[i] += np.frombuffer(d.as_py(), "<u4")[j]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["at", "df"])

    rows = blocks.select("terms", "df").mapInArrow(run, "at long, df long") \
        .groupBy("at").agg(F.sum("df").alias("df")).collect()
    return {r["at"]: r["df"] for r in rows}


def _item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """Items in bounded blocks, as (id, {term hash: repeats})."""
    block, size = [], 0
    for ident, text in items.select(item_col, text_col).toLocalIterator():
        col = pa.array([text], pa.string())
        held = Counter(h for _, some in terms(col) for h in some.tolist())
        block.append((ident, held))
        size += len(text or "")
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(blocks: DataFrame, block: list, weights: dict[int, int], k: int) -> DataFrame:
    """Each task's best k documents of every item of one block of items."""
    item = np.array([i for i, (_, held) in enumerate(block) for _ in held], np.int64)
    hashes = np.array([h for _, held in block for h in held], np.uint64)
    weight = np.array([weights.get(h, 0) * c for _, held in block for h, c in held.items()], np.int64)
    useful = weight > 0
    item, hashes, weight = item[useful], hashes[useful], weight[useful]
    n = len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k)
        for b in batches:
            for r in b.to_pylist():
                term = np.frombuffer(r["terms"], "<u8")
                slot = np.minimum(np.searchsorted(term, hashes), len(term) - 1)
                have = np.flatnonzero(term[slot] == hashes)
                if not len(have):
                    continue
                tree = Tree(r["tree"], r["height"])
                row = np.frombuffer(r["rows"], "<u4").astype(np.int64)[slot[have]]
                ids = np.frombuffer(r["ids"], "<i8")
                nulls = np.frombuffer(r["nulls"], bool)
                mine = item[have]
                at = 0
                while at < len(mine):                # whole items, some SLOTS terms at once
                    to = int(np.searchsorted(mine, mine[min(at + SLOTS, len(mine) - 1)]))
                    if at + SLOTS >= len(mine):
                        to = len(mine)
                    elif to <= at:
                        to = int(np.searchsorted(mine, mine[at], "right"))
                    descend(tree, mine[at:to], row[at:to], weight[have[at:to]], ids, nulls, best)
                    at = to
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.id, mask=best.null), pa.array(best.score)],
            ["no", "doc", "score"])

    return blocks.select("height", "ids", "nulls", "terms", "rows", "tree").mapInArrow(
        run, "no long, doc long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item id, ``rank`` (from 1), document id, score: the k best documents of
    every item with a score above 0, ties by document id."""
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField(item_col, items.schema[item_col].dataType),
        T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()),
        T.StructField("score", T.LongType())])
    n_docs, n_terms = totals(docs, text_col)
    found = spark.createDataFrame([], schema)
    if not n_terms:
        return found
    blocks = staged(index(docs, n_docs, n_terms, id_col, text_col), "treap-index")
    order = W.partitionBy("no").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    for some in _item_blocks(items, item_col, item_text):
        wanted = np.array(sorted({h for _, held in some for h in held}), np.uint64)
        df = document_counts(blocks, wanted)
        weights = {h: weight(df[i], n_docs) for i, h in enumerate(wanted.tolist()) if i in df}
        names = spark.createDataFrame([(i, ident) for i, (ident, _) in enumerate(some)],
                                      T.StructType([T.StructField("no", T.LongType()),
                                                    T.StructField(item_col, schema[item_col].dataType)]))
        top = _search(blocks, some, weights, k).withColumn("rank", F.row_number().over(order)) \
            .where(F.col("rank") <= k)
        part = top.join(names, "no").select(
            item_col, "rank", F.col("doc").alias(id_col), "score")
        found = found.unionAll(staged(part, "treap-found"))
    return found
