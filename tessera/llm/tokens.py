"""Whole-text tokenisation in Arrow batches with the tokenizers library.

A byte-level vocabulary splits text before merging, and a single space between
two visible characters, a punctuation mark after a letter, or a letter after a
mark (but the apostrophe) always begins a new piece there; a single line feed
between two visible characters is a piece. So a text may be cut there, but not
inside a special token's string, and the parts encoded alone with the same ids,
those of the library's defaults. ``Encoder`` cuts in numpy, encodes each distinct
part once, keeps the parts it has met (beyond ``MOST_PARTS``, those it has met
again since it last did so) and puts the ids together.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .base import span_hashes, utf8

END_ID = 0
MOST_PARTS = 800_000
JOINED = 4096                    # new parts that the library is handed as one text
_encoders: dict = {}

# Kinds of bytes, as bits. Bytes that cannot belong to white space: visible ASCII,
# and leads of two-byte characters but C2 (which has U+0085 and U+00A0).
_ASCII, _LEAD2, _TRAIL, _LETTER, _MARK, _OPEN, _LETTER2 = (1 << k for k in range(7))
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] |= _ASCII
_KIND[0xC3:0xE0] |= _LEAD2
_KIND[0x80:0xC0] |= _TRAIL
_KIND[65:91] |= _LETTER
_KIND[97:123] |= _LETTER
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _KIND[_c] |= _MARK | (_OPEN if _c != 39 else 0)     # a letter may join an apostrophe
# leads of two-byte characters that are all letters, but U+00D7 and U+00F7
_KIND[0xC3:0xCB] |= _LETTER2
_KIND[0xD0:0xD2] |= _LETTER2


def vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def part_starts(data: np.ndarray, off: np.ndarray, marks: bool = True,
                whole: list[bytes] = ()) -> np.ndarray:
    """Starts of the parts: rows, and the safe cuts inside them; without
    ``marks`` only those at spaces. The strings ``whole`` are not cut."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        kind = _KIND[data]
        before = (kind[1:-1] & _ASCII) != 0
        before[1:] |= ((kind[1:-2] & _LEAD2) != 0) & ((kind[2:-1] & _TRAIL) != 0)
        after = (kind & (_ASCII | _LEAD2)) != 0
        # cut at i: data[i] is the space, data[i - 1] and data[i + 1] visible
        cut[2:n - 1] = (data[2:n - 1] == 32) & before[:n - 3] & after[3:n]
        line = np.zeros(0, np.int64)
        if marks:
            line = np.flatnonzero(data[2:n - 1] == 10) + 2
            line = line[before[line - 2] & after[line + 1]]
            mark = np.flatnonzero(kind[2:] & _MARK) + 2
            lead, last = data[mark - 2], data[mark - 1]
            mark = mark[((kind[mark - 2] & _LETTER2) != 0) & ((kind[mark - 1] & _TRAIL) != 0)
                        & ((lead != 0xC3) | ((last != 0x97) & (last != 0xB7)))]
            cut[line] = cut[mark] = True
        cut[off[1:] - 1] = False          # the next byte is another row's
        first = off[:-1] + 1
        cut[first[first < n]] &= (kind[first[first < n] - 1] & _ASCII) != 0
        if marks:
            cut[line[cut[line]] + 1] = True
            cut[1:n] |= ((kind[1:] & _MARK) != 0) & ((kind[:-1] & _LETTER) != 0)
            cut[1:n] |= ((kind[1:] & _LETTER) != 0) & ((kind[:-1] & _OPEN) != 0)
        raw = data.tobytes() if whole else b""
        for text in whole:
            at = raw.find(text)
            while at >= 0:
                cut[at + 1:at + len(text)] = False
                at = raw.find(text, at + 1)
    cut[off] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size()
        # a byte-level token has one character per byte; a special one its own text
        found = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(found.values(), default=0) + 1, np.int64)
        self.bytes[list(found.values())] = [len(t) for t in found]
        for i, t in self.tok.get_added_tokens_decoder().items():
            self.bytes[i] = len(t.content.encode())
        self.clear()

    def clear(self):
        self.n, self.n_ids = 0, 0        # parts and ids held; the arrays are longer
        self.keys = np.zeros(1 << 10, np.uint64)
        self.at = np.zeros(1 << 10, np.int64)
        self.len = np.zeros(1 << 10, np.int64)
        self.again = np.zeros(1 << 10, bool)
        self.ids = np.zeros(1 << 12, np.uint32)
        self.table = np.full(1 << 12, -1, np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The part of each key, -1 where it is not held: the table is walked
        from the key's place to the part or a free place."""
        last = len(self.table) - 1
        place = (key & np.uint64(last)).astype(np.int64)
        slot = self.table[place]
        on = np.flatnonzero((slot >= 0) & (self.keys[slot] != key))
        while len(on):
            place[on] = (place[on] + 1) & last
            slot[on] = found = self.table[place[on]]
            on = on[(found >= 0) & (self.keys[found] != key[on])]
        return slot

    def _add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray):
        """Hold further parts, none of them held yet."""
        had, self.n = self.n, self.n + len(keys)
        at = self.n_ids + np.cumsum(size) - size
        for name, values, start in (("keys", keys, had), ("at", at, had), ("len", size, had),
                                    ("again", np.zeros(len(keys), bool), had), ("ids", ids, self.n_ids)):
            a = getattr(self, name)
            if start + len(values) > len(a):
                a = np.concatenate([a[:start], np.zeros(start + 2 * len(values), a.dtype)])
                setattr(self, name, a)
            a[start:start + len(values)] = values
        self.n_ids += len(ids)
        if 2 * self.n > len(self.table):
            self.table, had = np.full(1 << (4 * self.n).bit_length(), -1, np.int32), 0
        todo, last = np.arange(had, self.n), len(self.table) - 1
        place = (self.keys[todo] & np.uint64(last)).astype(np.int64)
        while len(todo):
            free = self.table[place] < 0
            self.table[place[free]] = todo[free]                  # of several, one stays
            left = self.table[place] != todo
            todo, place = todo[left], (place[left] + 1) & last

    def _forget(self):
        """Keep the parts met again since the last time; none, if they are too many."""
        kept = np.flatnonzero(self.again[:self.n])
        keys, at, size, ids = self.keys[kept], self.at[kept], self.len[kept], self.ids
        self.clear()
        if len(kept) <= MOST_PARTS // 2:
            self._add(keys, size, _gather(ids, at, size))

    def _learn(self, keys, data, start, stop):
        joined = self._joinable(data, start, stop)
        if joined.any():
            got = self._encode_joined(data, start[joined], stop[joined])
            if got is None:
                joined[:] = False
            else:
                self._add(keys[joined], *got)
        one = ~joined
        if one.any():
            got = [e.ids for e in self.tok.encode_batch_fast(
                [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start[one], stop[one])],
                add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            self._add(keys[one], size, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())))

    def _joinable(self, data, start, stop):
        """Parts that begin with a visible character, or a space and one, and
        end with one: after another, the latter at once and the former after a
        line feed, they have the ids they have alone."""
        if any(c in s for s in self.special for c in (b" ", b"\n")):
            return np.zeros(len(start), bool)
        head = start + (data[start] == 32)
        ok = head < stop
        head = np.minimum(head, stop - 1)
        ok &= (_KIND[data[head]] & (_ASCII | _LEAD2)) != 0
        last, before = _KIND[data[stop - 1]], _KIND[data[np.maximum(stop - 2, head)]]
        return ok & (((last & _ASCII) != 0) | (((before & _LEAD2) != 0) & ((last & _TRAIL) != 0)))

    def _encode_joined(self, data, start, stop):
        """(ids of each part, all ids) of joinable parts, ``JOINED`` to a text.
        The ids' bytes are the text's, so the parts' ends are found by counting
        them; None where they are not."""
        size = stop - start
        feed = data[start] != 32
        to = np.cumsum(size + feed)
        text = np.full(to[-1], 10, np.uint8)
        text[_runs(to - size, size)] = _gather(data, start, size)
        raw = text.tobytes()
        bounds = [0, *to[JOINED - 1:-1:JOINED].tolist(), int(to[-1])]
        try:
            texts = [raw[s:e].decode() for s, e in zip(bounds, bounds[1:])]
        except UnicodeDecodeError:
            return None
        got = [np.array(e.ids, np.uint32) for e in
               self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got)
        end = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        a, b = np.searchsorted(end, to - size), np.searchsorted(end, to)
        if end[-1] != to[-1] or (end[a] != to - size).any() or (end[b] != to).any():
            return None
        return b - a, _gather(ids, a, b - a)

    def encode(self, col: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts, ``end`` appended to each."""
        data, off = utf8(col)
        start = part_starts(data, off, whole=self.special)
        stop = np.append(start[1:], len(data))
        key = span_hashes(data, start, stop)
        slot = self._find(key)
        if self.n + np.count_nonzero(slot < 0) > MOST_PARTS:
            self._forget()
            slot = self._find(key)
        new = np.flatnonzero(slot < 0)
        self.again[slot[slot >= 0]] = True
        if len(new):
            _, some = np.unique(key[new], return_index=True)
            some = new[some]
            self._learn(key[some], data, start[some], stop[some])
            slot[new] = self._find(key[new])
        at, size = self.at[slot], self.len[slot]
        part = np.searchsorted(start, off)                       # first part of each row
        per_row = np.diff(np.concatenate([[0], np.cumsum(size)])[part])
        extra = 0 if end is None else 1
        first = np.concatenate([[0], np.cumsum(per_row + extra)])
        out = np.full(first[-1], end or 0, np.uint32)
        held = np.ones(first[-1], bool)
        if extra:
            held[first[1:] - 1] = False
        out[held] = _gather(self.ids, at, size)
        return out, first


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of runs, one run after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return values[_runs(at, size)]


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary; its parts serve all tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
