"""Alignment of two tokenizers by byte offsets, scored by inverted pair bitmaps.

Every text, with a space before it, is encoded by a byte-level vocabulary (A)
and by a piece vocabulary with byte fallback (B). Both begin a new token at a
single space between two visible characters, so a worker cuts texts there,
encodes and aligns each distinct part once, and puts documents together from
parts. Tokens are the segments between byte ends: where ends of A and B meet, a
group closes; every segment between neighbouring ends of either is one linked
pair of occurrences.

A task numbers its documents in blocks (``BLOCK_DOCS`` documents or
``BLOCK_LINKS`` postings). Per block and id pair it writes one row: the bitmap of
the block's documents that hold the pair, as the numbers of its non-empty bytes
and, for each bit of a document's number of links, those bytes (a multiplicity
plane). The bitmaps of slices are OR-merged within the block; the OR of all
planes has the documents, its popcount their number, and the planes' popcounts,
times 2^j, the links. Blocks hold different documents, so a pair's counts are
sums over blocks. Scores return by the postings: each row meets its pair's
count, rows gather by block, and a plane's bits add 2^j times the score to their
documents. Neither a pair nor a document gathers more than a block in one task.

Cases: null or empty texts, and those that one of the vocabularies does not give
back byte by byte, have no tokens: zeros and an empty ``groups``. Strings of
special tokens are plain text. Repeated rows are documents of their own and count
as such; ids may be null or of any type; texts of any length are taken whole, in
pieces of ``CHUNK`` bytes; an empty table gives an empty one.
Parts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import slices, span_hashes, staged, utf8
from .bpe import byte_characters, spread
from .tokens import part_starts, vocabulary

BLOCK_DOCS = 1 << 14
BLOCK_LINKS = 1 << 21
CHUNK = 1 << 20
MOST_PARTS = 400_000
_aligners: dict = {}


def piece_vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class _Table:
    """Byte strings of ids, gathered for many ids at once."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spread(self.at[ids], self.size[ids])]


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.empty(int(size.sum()), np.int64)
    at = 0
    for r in rows:
        out[at:at + len(r)] = r
        at += len(r)
    return out, size


class Aligner:
    """The two vocabularies and the parts met. Per part: numbers of A ids, B
    ids, groups and links, whether both give the part back, its links as
    ``a * width + b`` and its groups as text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True      # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        a_text = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                  for t, i in self.a.get_vocab().items()}
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b_path}: a piece goes on after a space")
        self.a_bytes = _Table([a_text.get(i, b"") for i in range(max(a_text) + 1)])
        self.b_bytes = _Table([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else
            p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        most = max(len(a_text), max(a_text) + 1, self.width)
        self.decimal = _Table([b"%d," % i for i in range(most)])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.counts = np.zeros((0, 5), np.int64)         # a, b, groups, links, good
        self.first = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def learn(self, texts: list[str], data: np.ndarray, size: np.ndarray) -> None:
        """Align new parts, given as texts and as their bytes one after the other."""
        n = len(texts)
        a, n_a = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b, n_b = _flat(self.b.encode([t[1:] for t in texts], num_threads=1))
        row_a, row_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        good = np.ones(n, bool)
        for ids, row, t in ((a, row_a, self.a_bytes), (b, row_b, self.b_bytes)):
            good &= np.bincount(row, t.size[ids], n).astype(np.int64) == size
        for ids, row, t in ((a, row_a, self.a_bytes), (b, row_b, self.b_bytes)):
            same = t.of(ids[good[row]]) == data[np.repeat(good, size)]
            rows = np.repeat(np.arange(n), np.where(good, size, 0))
            good[rows[~same]] = False
        a, row_a, b, row_b = a[good[row_a]], row_a[good[row_a]], b[good[row_b]], row_b[good[row_b]]
        end_a, end_b = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        ends = np.union1d(end_a, end_b)
        at_a = np.searchsorted(end_a, ends)
        links = a[at_a] * self.width + b[np.searchsorted(end_b, ends)]
        n_links = np.bincount(row_a[at_a], minlength=n)
        close = np.intersect1d(end_a, end_b)
        n_groups = np.bincount(row_a[np.searchsorted(end_a, close)], minlength=n)
        blob, cut = self._texts(a, end_a, b, end_b, close, row_a, row_b, n)
        self.groups += [blob[x:y] for x, y in zip(cut.tolist(), cut[1:].tolist())]
        counts = np.stack([np.bincount(row_a, minlength=n), np.bincount(row_b, minlength=n),
                           n_groups, n_links, good], 1).astype(np.int64)
        self.first = np.concatenate([self.first,
                                     len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, links])
        self.counts = np.concatenate([self.counts, counts])

    def _texts(self, a, end_a, b, end_b, close, row_a, row_b, n):
        """``a1,a2|b1;`` of all groups as one string, and where parts end."""
        g_a, g_b = np.searchsorted(close, end_a), np.searchsorted(close, end_b)
        order = np.argsort(np.concatenate([g_a * 2, g_b * 2 + 1]), kind="stable")
        ids = np.concatenate([a, b])[order]
        side = np.concatenate([np.zeros(len(a), bool), np.ones(len(b), bool)])[order]
        group = np.concatenate([g_a, g_b])[order]
        out = self.decimal.of(ids)
        size = self.decimal.size[ids]
        if len(ids):
            last = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), True)
            stop = np.cumsum(size) - 1
            out[stop[last & ~side]] = ord("|")
            out[stop[last & side]] = ord(";")
        row = np.concatenate([row_a, row_b])[order]
        cut = np.concatenate([[0], np.cumsum(np.bincount(row, size, n).astype(np.int64))])
        return out.tobytes(), cut

    def parts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Numbers of the given parts among those met."""
        key, some, back = np.unique(span_hashes(data, start, stop), return_index=True,
                                    return_inverse=True)
        if len(self.keys) + len(key) > MOST_PARTS:
            self.clear()
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        near = place < len(self.keys)
        known[near] = self.keys[place[near]] == key[near]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            x, y = start[some[new]], stop[some[new]]
            here = len(self.counts) + np.arange(len(new))
            self.learn([raw[p:q].decode("utf-8", "replace") for p, q in zip(x.tolist(), y.tolist())],
                       data[spread(x, y - x)], y - x)
            self.keys = np.insert(self.keys, place[new], key[new])
            self.slot = np.insert(self.slot, place[new], here)
            place = np.searchsorted(self.keys, key)
        return self.slot[place][back]

    def align(self, col: pa.Array):
        """Of whole texts: counts per row (n, 4), groups texts, and the links of
        all rows as chunks of (row, pair)."""
        data, off = utf8(col)
        n = len(off) - 1
        data = np.insert(data, off[:-1], 32)
        off = off + np.arange(n + 1)
        start = part_starts(data, off, marks=False)
        stop = np.append(start[1:], len(data))
        row = np.searchsorted(off, start, "right") - 1
        total = np.zeros((n, 5), np.int64)
        texts, sizes, links = [], np.zeros(n, np.int64), []
        at = 0
        while at < len(start):
            to = max(int(np.searchsorted(stop, start[at] + CHUNK, "right")), at + 1)
            base = start[at]
            part = self.parts(data[base:stop[to - 1]], start[at:to] - base, stop[at:to] - base)
            rows, counts = row[at:to], self.counts[part]
            np.add.at(total, rows, np.where([1, 1, 1, 1, 0], counts, 1 - counts))
            some = [self.groups[p] for p in part.tolist()]
            sizes += np.bincount(rows, list(map(len, some)), n).astype(np.int64)
            texts += some
            links.append((np.repeat(rows, counts[:, 3]),
                          self.links[spread(self.first[part], counts[:, 3])]))
            at = to
        good = (total[:, 4] == 0) & (np.diff(off) > 1)
        total[~good] = 0
        blob = b"".join(texts)
        cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        groups = [blob[x:y - 1].decode() if g and y > x else "" for x, y, g in zip(cut, cut[1:], good.tolist())]
        return total[:, :4], groups, [(r[good[r]], p[good[r]]) for r, p in links]


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path)
    return _aligners[key]


# --- bitmaps ------------------------------------------------------------------

def planes(key: np.ndarray, count: np.ndarray):
    """Bitmaps of a block from its postings, sorted by ``pair << 16 | document``,
    and their numbers of links. Per pair: the pair, documents, links, and as flat
    bytes with offsets the numbers of non-empty bytes (u16) and the planes."""
    bit = (1 << (key & 7)).astype(np.uint8)
    cell = np.flatnonzero(np.append(True, (key >> 3)[1:] != (key >> 3)[:-1]))
    pair_of = key[cell] >> 16
    first = np.flatnonzero(np.append(True, pair_of[1:] != pair_of[:-1]))
    cells = np.diff(np.append(first, len(cell)))
    depth = int(count.max()).bit_length()
    level = [np.bitwise_or.reduceat(np.where(count >> j & 1, bit, 0).astype(np.uint8), cell)
             for j in range(depth)]
    used = [np.bitwise_or.reduceat(x, first) > 0 for x in level]
    n_planes = np.max([(j + 1) * u for j, u in enumerate(used)], axis=0)
    held = np.bitwise_or.reduce(level, axis=0)           # documents of all planes
    n_docs = np.add.reduceat(np.bitwise_count(held).astype(np.int64), first)
    n_links = np.zeros(len(first), np.int64)
    size = n_planes * cells
    base = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    which = np.repeat(np.arange(len(first)), cells)
    inner = np.arange(len(cell)) - np.repeat(first, cells)
    for j, x in enumerate(level):
        n_links += np.add.reduceat(np.bitwise_count(x).astype(np.int64), first) << j
        mine = n_planes[which] > j
        out[(base[which] + j * cells[which] + inner)[mine]] = x[mine]
    at = ((key[cell] & 0xFFFF) >> 3).astype("<u2")
    return (pair_of[first], n_docs, n_links, at.tobytes(), np.append(0, np.cumsum(cells * 2)),
            out.tobytes(), np.append(base, len(out)))


def returned(at: pa.Array, plane: pa.Array, scores: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each score column, per document the sum over its links."""
    at_data, at_off = utf8(at)
    data, off = utf8(plane)
    cells = np.diff(at_off) // 2
    byte = at_data.copy().view("<u2").astype(np.int64)
    row = np.repeat(np.arange(len(cells)), np.diff(off))
    inner = np.arange(len(data)) - off[row]
    j, c = np.divmod(inner, np.maximum(cells[row], 1))
    doc = byte[at_off[row] // 2 + c] * 8
    hit = np.flatnonzero(np.unpackbits(data, bitorder="little"))
    src = hit >> 3
    doc = doc[src] + (hit & 7)
    out = []
    for s in scores:
        total = np.zeros(n, np.int64)
        np.add.at(total, doc, s[row[src]] << j[src])
        out.append(total)
    return out


def _binary(data: bytes, off: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [
        None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data)])


_DOC = ["n_a", "n_b", "n_groups", "n_links"]
_PAIR = "a int, b int, pair_docs long, pair_links long, bytes binary, planes binary"


class _Block:
    """Documents and postings of a task since the last written block."""

    def __init__(self, part: int, width: int):
        self.number, self.width = part << 32, width
        self.start()

    def start(self) -> None:
        self.docs, self.keys, self.counts, self.size = 0, [], [], 0

    def add(self, links) -> None:
        for row, pair in links:
            key, count = np.unique(pair << 16 | (row + self.docs), return_counts=True)
            self.keys.append(key)
            self.counts.append(count)
            self.size += len(key)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.size:
            key = np.concatenate(self.keys)
            count = np.concatenate(self.counts)
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            pair, n_docs, n_links, at, at_off, data, off = planes(
                key[first], np.add.reduceat(count, first))
            at, data = _binary(at, at_off), _binary(data, off)
            for i in range(0, len(pair), 20_000):
                p = pair[i:i + 20_000]
                cols = {"block": np.full(len(p), self.number), "a": (p // self.width),
                        "b": (p % self.width), "pair_docs": n_docs[i:i + 20_000],
                        "pair_links": n_links[i:i + 20_000], "bytes": at[i:i + 20_000],
                        "planes": data[i:i + 20_000]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], f.type) if f.name in cols else
                     pa.nulls(len(p), f.type) for f in schema], schema=schema)
        self.number += 1
        self.start()


def index(docs: DataFrame, a_vocab: str | None = None, b_vocab: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: one per document (block, pos, id, counts, ``groups``
    text ``a1,a2|b1;a3|b2,b3``), and one per block and id pair (block, a, b, its
    counts and bitmaps; pos null)."""
    a_path, b_path = vocabulary(a_vocab), piece_vocabulary(b_vocab)
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("pos", T.IntegerType()),
         T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in _DOC] + [T.StructField("groups", T.StringType())]
        + T.StructType.fromDDL(_PAIR).fields)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        al = aligner(a_path, b_path)
        block = _Block(TaskContext.get().partitionId(), al.width)
        for b in slices(batches, "text"):
            counts, groups, links = al.align(b.column("text"))
            block.add(links)
            n = b.num_rows
            cols = {"block": np.full(n, block.number), "pos": block.docs + np.arange(n),
                    "groups": groups, **{c: counts[:, k] for k, c in enumerate(_DOC)}}
            yield pa.RecordBatch.from_arrays(
                [b.column("id") if f.name == "id" else
                 pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type)
                 for f in out], schema=out)
            block.docs += n
            if block.docs >= BLOCK_DOCS or block.size >= BLOCK_LINKS:
                yield from block.rows(out)
        yield from block.rows(out)

    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per id pair over all blocks: documents and links."""
    return rows.where("pos IS NULL").groupBy("a", "b").agg(
        F.sum("pair_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))


def align(docs: DataFrame, a_vocab: str | None = None, b_vocab: str | None = None,
          id_col: str = "doc_id", text_col: str = "text",
          carry: Column | None = None) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best (links
    whose pair is the most frequent of its B id, ties included), count_sum (the
    pairs' link counts over its links), groups. ``carry`` is made of the groups
    text and kept in its place."""
    rows = index(docs, a_vocab, b_vocab, id_col, text_col)
    if carry is not None:
        rows = rows.withColumn("groups", F.when(F.col("pos").isNotNull(), carry))
    rows = staged(rows, "align-rows")
    pairs = staged(pair_counts(rows).drop("n_docs"), "align-pairs")
    best = pairs.groupBy("b").agg(F.max("n_links").alias("most"))
    scores = pairs.join(best, "b").select(
        "a", "b", F.col("n_links").alias("count"),
        (F.col("n_links") == F.col("most")).cast("long").alias("best"))
    mine = ["block", "pos", "id", *_DOC, "groups", "bytes", "planes", "count", "best"]
    postings = rows.where("pos IS NULL").join(scores, ["a", "b"]).select(mine)
    documents = rows.where("pos IS NOT NULL") \
        .withColumn("count", F.lit(None).cast("long")).withColumn("best", F.lit(None).cast("long")) \
        .select(mine)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)]
                          + [T.StructField(c, T.LongType()) for c in _DOC]
                          + [T.StructField("n_best", T.LongType()),
                             T.StructField("count_sum", T.LongType()), rows.schema["groups"]])

    def score(table: pa.Table) -> pa.Table:
        pos = table.column("pos")
        doc = table.filter(pos.is_valid())
        post = table.filter(pos.is_null()).combine_chunks()
        at = np.asarray(doc.column("pos"))
        total = [np.zeros(len(at), np.int64)] * 2
        if post.num_rows:
            total = returned(post.column("bytes"), post.column("planes"),
                             [np.asarray(post.column(c)) for c in ("best", "count")],
                             int(at.max()) + 8)
            total = [t[at] for t in total]
        return pa.table([doc.column("id"), *(doc.column(c) for c in _DOC),
                         *(pa.array(t) for t in total), doc.column("groups")],
                        names=schema.names)

    return postings.unionByName(documents).groupBy("block").applyInArrow(score, schema)
