"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A slice of texts is cut into words (the split pattern of byte-level
vocabularies, worked out from character classes), each distinct word is merged
once, and the ids are put together by row. Merging holds the symbols of many
words in one flat array. A round takes the key ``left << 32 | right`` of every
neighbouring pair, finds its rank by binary search over the sorted pair keys of
the vocabulary, and joins each word's lowest-ranked pair at all its places, from
the left. Words without a known pair leave the array. Words of more than
``LONG`` bytes would need a round for nearly every rank: their pairs wait in
buckets by rank instead, and a round joins one rank at all its places and looks
up only the pairs it touched, so a word of n bytes costs about n lookups.

Both orders are the one of merging the lowest rank first because a vocabulary
learned by merging has the merges that make a symbol before those that use it;
``Bpe`` checks that and the other settings, and raises where they differ.

Cases: a null or empty text has no ids; texts of any length are encoded whole;
rows repeat as they come; an empty table gives an empty one; other columns of
the input are not touched. Ids that the vocabulary lacks decode to nothing, and
bytes that are no UTF-8 to U+FFFD, both as in the tokenizers library.
Words are told apart by 64-bit hashes; ``MOST_WORDS`` bounds those a worker
keeps (then it starts over), not what is encoded.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import slices, span_hashes, utf8
from .tokens import part_starts, vocabulary

LONG = 256
PIECE = 1 << 20
MOST_WORDS = 800_000
NONE = np.int32(2 ** 31 - 1)
_OTHER, _LETTER, _DIGIT, _SPACE, _UNKNOWN = range(5)
_models: dict = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: the
    visible Latin-1 ones for themselves, the rest from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in visible)
    shifted = {b: 256 + k for k, b in enumerate(rest)}
    return [chr(shifted.get(b, b)) for b in range(256)]


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices at[0] .. at[0] + size[0] - 1, at[1] .. of consecutive runs."""
    total = int(size.sum())
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)


def alternate(run: np.ndarray) -> np.ndarray:
    """Every second entry of each chain, from its first; ``run[i]`` says that
    entry i + 1 continues the chain of entry i."""
    n = len(run) + 1
    head = np.ones(n, bool)
    head[1:] = ~run
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return (np.arange(n) - start) % 2 == 0


class Bpe:
    """A byte-level BPE vocabulary in the tokenizers file format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token")
                 and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
                 and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                             for t in spec["added_tokens"]))
        if not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        # the library classifies characters; its merges are not used
        self.split = Tokenizer.from_file(path).pre_tokenizer
        vocab = model["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in (
            [m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        rank = np.arange(len(merges))
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = rank
        if (np.maximum(born[left], born[right]) >= rank).any():
            raise ValueError(f"{path}: a merge uses a symbol made after it")
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.rank = key[order], rank[order].astype(np.int32)
        self.made = made.astype(np.int32)                          # by rank
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        text = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                for t, i in vocab.items()}
        text |= {i: t for t, i in self.special.items()}
        size = np.zeros(max(text) + 1, np.int64)
        for i, t in text.items():
            size[i] = len(t)
        self.size = size
        self.at = np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(text[i] for i in sorted(text)), np.uint8)
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.clear()

    # --- words ---------------------------------------------------------------

    def clear(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Class of each character. The split pattern's classes are those of
        the library's Unicode tables, so a character not met before is shown to
        the library beside one of each class."""
        kind = self.kind[points]
        if (kind == _UNKNOWN).any():
            for p in np.unique(points[kind == _UNKNOWN]).tolist():
                joins = [k for k, c in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!"))
                         if len(self.split.pre_tokenize_str(c + chr(p))) == 1]
                self.kind[p] = joins[0] if joins else _SPACE
            kind = self.kind[points]
        return kind

    def words(self, data: np.ndarray, off: np.ndarray):
        """(starts, stops, id of a special token or -1) of all words."""
        n = len(data)
        edge = np.zeros(n + 1, bool)          # no word spans these
        edge[off] = True
        special = np.full(n + 1, -1, np.int64)
        inside = np.zeros(n + 1, bool)
        raw = data.tobytes()
        for text, i in self.special.items():
            at = raw.find(text)
            while at >= 0:
                stop = at + len(text)
                if not edge[at + 1:stop].any() and not inside[at]:
                    special[at], edge[at], edge[stop] = i, True, True
                    inside[at:stop] = True
                at = raw.find(text, stop)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        lead = lead[~inside[lead] | (special[lead] >= 0)]
        b = data[lead].astype(np.int64)
        wide = np.append(data, np.zeros(3, np.uint8)).astype(np.int64) & 0x3F
        points = np.where(
            b < 0x80, b, np.where(
                b < 0xE0, (b & 0x1F) << 6 | wide[lead + 1], np.where(
                    b < 0xF0, (b & 0x0F) << 12 | wide[lead + 1] << 6 | wide[lead + 2],
                    (b & 0x07) << 18 | wide[lead + 1] << 12 | wide[lead + 2] << 6
                    | wide[lead + 3])))
        m = len(lead)
        kind = self.kinds(points)
        kind[special[lead] >= 0] = _UNKNOWN                  # a class of its own
        if not m:
            return lead, lead, special[:0]
        border = edge[lead]
        cut = border.copy()
        cut[1:] |= kind[1:] != kind[:-1]                     # runs of one class
        last = np.append(border[1:], True)                   # the segment ends after it
        space = kind == _SPACE
        ends = space & ~last & np.append(~space[1:], True)   # last space before a word
        cut |= ends
        joined = np.append(False, (ends & (points == 32))[:-1])
        cut[joined] = False                                  # ' word' is one piece
        # 's 't 'm 'd 're 've 'll: an apostrophe that begins a piece
        ap = np.flatnonzero((points == 39) & cut & ~last)
        if len(ap):
            p = np.append(points, [0, 0])
            open2 = np.append(~border, [False, False])
            one = np.isin(p[ap + 1], [ord(c) for c in "stmd"])
            two = np.zeros(len(ap), bool)
            for x, y in ("re", "ve", "ll"):
                two |= (p[ap + 1] == ord(x)) & (p[ap + 2] == ord(y)) & open2[ap + 2]
            for a, k in ((ap[one], 2), (ap[two], 3)):
                cut[a + 1] = False
                after = a + k
                cut[after[after < m]] = True
        starts = lead[cut]
        return starts, np.append(starts[1:], n), special[starts]

    # --- merging -------------------------------------------------------------

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the vocabulary has no such merge."""
        key = left.astype(np.int64) << 32 | right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[slot] == key, self.rank[slot], NONE)

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as byte symbols one after the other, and their
        numbers of ids."""
        word = np.repeat(np.arange(len(size)), size)
        long = size > LONG
        done = []
        if long.any():
            mine = long[word]
            done.append(self.merge_long(sym[mine], word[mine]))
            sym, word = sym[~mine], word[~mine]
        while len(sym):
            rank = np.full(len(sym), NONE)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.lookup(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first),
                              np.diff(np.append(first, len(sym))))
            over = least == NONE
            done.append((sym[over], word[over]))
            hit = np.flatnonzero((rank == least) & ~over)
            if not len(hit):
                break
            hit = hit[alternate(np.diff(hit) == 1)]
            sym = sym.copy()
            sym[hit] = self.made[rank[hit]]
            keep = ~over
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym = np.concatenate([d[0] for d in done]) if done else sym
        word = np.concatenate([d[1] for d in done]) if done else word
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(size))

    def merge_long(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sym)
        sym = sym.copy()
        here = np.arange(n)
        follows = np.append(word[1:] == word[:-1], False)
        nxt = np.where(follows, here + 1, -1)
        prv = np.where(np.append(False, follows[:-1]), here - 1, -1)
        rank = np.full(n, NONE)
        waiting: dict[int, list] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[at >= 0]
            has = nxt[at] >= 0
            rank[at[~has]] = NONE
            at = at[has]
            rank[at] = self.lookup(sym[at], sym[nxt[at]])
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            values, begin = np.unique(rank[at], return_index=True)
            for r, some in zip(values.tolist(), np.split(at, begin[1:])):
                if r not in waiting:
                    heapq.heappush(heap, r)
                    waiting[r] = []
                waiting[r].append(some)

        look(here)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[alternate(nxt[at[:-1]] == at[1:])]
            gone = nxt[at]
            sym[at] = self.made[r]
            rank[gone] = NONE
            after = nxt[gone]
            nxt[gone] = -2
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            look(np.unique(np.concatenate([at, prv[at]])))
        left = nxt != -2
        return sym[left], word[left]

    # --- whole texts ---------------------------------------------------------

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts. Long ones are taken in pieces of about
        ``PIECE`` bytes, cut where a word begins whatever stands around it."""
        data, off = utf8(col)
        if len(data) <= 2 * PIECE:
            return self._encode(data, off)
        start = part_starts(data, off, marks=False, whole=list(self.special))
        grid = np.searchsorted(start, np.arange(PIECE, len(data), PIECE))
        cut = np.unique(np.concatenate([off, start[np.minimum(grid, len(start) - 1)]]))
        ids, count = [], np.zeros(len(off) - 1, np.int64)
        at = 0
        while at < len(cut) - 1:
            # whole pieces, about PIECE bytes of them together
            to = max(int(np.searchsorted(cut, cut[at] + PIECE, "right")) - 1, at + 1)
            here = cut[at:to + 1]
            got, first = self._encode(data[here[0]:here[-1]], here - here[0])
            ids.append(got)
            np.add.at(count, np.searchsorted(off, here[:-1], "right") - 1, np.diff(first))
            at = to
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(count)])

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, stop, special = self.words(data, off)
        key, some, part = np.unique(span_hashes(data, start, stop), return_index=True,
                                    return_inverse=True)
        if len(self.seen) + len(key) > MOST_WORDS:
            self.clear()
        slot = np.searchsorted(self.seen, key)
        known = np.zeros(len(key), bool)
        near = slot < len(self.seen)
        known[near] = self.seen[slot[near]] == key[near]
        # a special token's string is never merged as a word (its hash differs
        # from no word's, so it is kept out of the words seen)
        extra = np.flatnonzero(special[some] >= 0)
        known[extra] = True
        new = np.flatnonzero(~known)
        if len(new):
            a, z = start[some[new]], stop[some[new]]
            ids, count = self.merge(self.byte_id[data[spread(a, z - a)]], z - a)
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, ids])
            place = np.searchsorted(self.seen, key[new])
            self.seen, self.first, self.count = (np.insert(x, place, y) for x, y in (
                (self.seen, key[new]), (self.first, first), (self.count, count)))
        if len(extra):
            at = np.full(len(key), len(self.ids))
            count = np.ones(len(key), np.int64)
            normal = np.ones(len(key), bool)
            normal[extra] = False
            slot = np.searchsorted(self.seen, key[normal])
            at[normal], count[normal] = self.first[slot], self.count[slot]
            at[extra] += np.arange(len(extra))
            pool = np.concatenate([self.ids, special[some[extra]].astype(np.int32)])
        else:
            slot = np.searchsorted(self.seen, key)
            at, count, pool = self.first[slot], self.count[slot], self.ids
        out = pool[spread(at[part], count[part])]
        rows = np.searchsorted(off, start, "right") - 1
        per_row = np.bincount(rows, count[part], len(off) - 1).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per_row)])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """Texts of rows of ids."""
        known = (ids >= 0) & (ids < len(self.size))
        size = np.where(known, self.size[np.where(known, ids, 0)], 0)
        data = self.bytes[spread(self.at[np.where(known, ids, 0)], size)]
        run = np.concatenate([[0], np.cumsum(size)])
        cut = run[off]
        raw = data.tobytes()
        begins = cut[:-1][cut[:-1] < len(data)]
        try:
            raw.decode()
            whole = not ((data[begins] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.LargeStringArray.from_buffers(
                len(off) - 1, pa.py_buffer(cut.astype(np.int64).tobytes()),
                pa.py_buffer(raw)).cast(pa.string())
        return pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(cut, cut[1:])],
                        pa.string())


def model(path: str) -> Bpe:
    """One per worker process and vocabulary; its words serve all tasks."""
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def encode(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id (its type kept) and ``ids array<int>``,
    those of the whole text, special tokens' strings as their ids as the library
    does by default."""
    path = vocabulary(vocab)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in slices(batches, "text"):
            ids, off = bpe.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()),
                                                          pa.array(ids, pa.int32()))],
                [id_col, "ids"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: str | None = None, ids_col: str = "ids",
           text_col: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids_col``, special tokens written out; null
    ids as none."""
    path = vocabulary(vocab)
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            for at, to in _cuts(b.column(ids_col)):
                part = b.slice(at, to - at)
                ids, off = flat_ids(part.column(ids_col))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, bpe.decode(ids, off)], [*part.schema.names, text_col])

    return rows.mapInArrow(run, schema)


def flat_ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    size = np.asarray(col.value_lengths().fill_null(0), np.int64) if len(col) else \
        np.zeros(0, np.int64)
    return np.asarray(col.flatten()), np.concatenate([[0], np.cumsum(size)])


def _cuts(col: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` ids (one longer row stands alone)."""
    _, off = flat_ids(col)
    at = 0
    while at < len(col):
        to = max(int(np.searchsorted(off, off[at] + most, "right")) - 1, at + 1)
        yield at, min(to, len(col))
        at = min(to, len(col))
