"""Inverted index in blocks of documents, and BM25 scoring over it.

A block holds the postings of up to ``DOC_ROWS`` documents: sorted terms, and per
term its documents with their counts, the greatest count and the least document
length. The last two bound what the term can add to any score in the block
whatever the corpus statistics are, so an index is built once and serves any
query batch. Against a block of queries, a query is scored only where the sum
of its terms' bounds can still enter its k best; the postings of all others stay
unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import QUERY_ROWS, Running, grid, list_offsets, packed

DOC_ROWS = 512
#: Postings and scores worked on at once (entries of one numpy array).
ENTRIES = 1 << 21


def _one(value, kind) -> pa.Array:
    """A list column of one row."""
    value = value if isinstance(value, pa.Array) else pa.array(value, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)


def index_block(docs: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of documents (id, host, dl, terms, tfs)."""
    off = list_offsets(docs.column("terms"))
    flat = docs.column("terms").flatten().dictionary_encode()
    words = flat.dictionary
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    term = rank[np.asarray(flat.indices, np.int64)]
    doc = np.repeat(np.arange(docs.num_rows), np.diff(off))
    tf = np.asarray(docs.column("tfs").flatten(), np.int64)
    dl = np.asarray(docs.column("dl").fill_null(0), np.int64)
    by = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by], np.arange(len(words) + 1))
    some = len(words) > 0
    return pa.RecordBatch.from_arrays(
        [_one(docs.column("id"), None), _one(docs.column("host"), None), _one(dl, pa.int64()),
         _one(words.take(pa.array(order)), None), _one(first, pa.int32()),
         _one(doc[by], pa.int32()), _one(tf[by], pa.int32()),
         _one(np.maximum.reduceat(tf[by], first[:-1]) if some else [], pa.int32()),
         _one(np.minimum.reduceat(dl[doc[by]], first[:-1]) if some else [], pa.int64())],
        ["id", "host", "dl", "terms", "first", "doc", "tf", "most", "least"])


def posting_blocks(counted: DataFrame) -> DataFrame:
    """(block, payload) of documents (id, host, dl, terms, tfs)."""
    return packed(counted, DOC_ROWS, index_block)


class Scorer:
    """A block of queries (id, site, terms array<struct<term, idf>>, avgdl) with
    its running top-k over blocks of postings."""

    def __init__(self, block: pa.RecordBatch, k: int, k1: float, b: float, margin: float,
                 names: list[str]):
        self.ids, self.names, self.k1, self.b = block.column("id"), names, k1, b
        off = list_offsets(block.column("terms"))
        entry = block.column("terms").flatten()
        flat = entry.field("term").dictionary_encode()
        self.words = flat.dictionary
        self.word = np.asarray(flat.indices, np.int64)
        self.idf = np.asarray(entry.field("idf"), np.float64)
        self.query = np.repeat(np.arange(block.num_rows), np.diff(off))
        self.avgdl = block.column("avgdl")[0].as_py() or 1.0
        self.sites: dict[str, list[int]] = {}
        for i, site in enumerate(block.column("site").to_pylist()):
            if site is not None:
                self.sites.setdefault(site, []).append(i)
        self.best = Running(block.num_rows, k, margin, 0.0)
        self.read = 0                                     # postings

    def norm(self, dl: np.ndarray) -> np.ndarray:
        return self.k1 * ((1.0 - self.b) + self.b * dl / self.avgdl)

    def meet(self, block: pa.RecordBatch) -> None:
        col = {n: block.column(n).flatten() for n in block.schema.names}
        at = pc.index_in(self.words, value_set=col["terms"]).fill_null(-1).to_numpy()[self.word]
        have = np.flatnonzero(at >= 0)
        if not len(have):
            return
        at, query, idf = at[have], self.query[have], self.idf[have]
        n = len(self.ids)
        most = np.asarray(col["most"], np.float64)[at]
        bound = np.bincount(query, idf * most * (self.k1 + 1.0) / (
            most + self.norm(np.asarray(col["least"], np.float64)[at])), n)
        alive = (bound > 0) & (bound * (1 + 1e-9) >= self.best.floor - self.best.margin)
        stay = alive[query]
        at, query, idf = at[stay], query[stay], idf[stay]
        which = np.flatnonzero(alive)
        first, doc, tf = (np.asarray(col[c], np.int64) for c in ("first", "doc", "tf"))
        size = first[at + 1] - first[at]
        norm = self.norm(np.asarray(col["dl"], np.float64))
        docs = len(norm)
        rows = max(1, ENTRIES // docs)
        lo = 0
        while lo < len(which):
            # queries whose scores, and postings, fit in one array
            a = np.searchsorted(query, which[lo])
            run = np.cumsum(size[a:])
            far = int(np.searchsorted(run, ENTRIES, "right"))
            last = query[a + far] if a + far < len(query) else n
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(which, last))))
            z = len(query) if hi >= len(which) else np.searchsorted(query, which[hi])
            count = size[a:z]
            src = np.repeat(first[at[a:z]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            q = np.repeat(np.searchsorted(which, query[a:z]) - lo, count)
            f = tf[src].astype(np.float64)
            # same operation order as the SQL form of the weight
            w = np.repeat(idf[a:z], count) * f * (self.k1 + 1.0) / (f + norm[doc[src]])
            scores = np.bincount(q * docs + doc[src], w, (hi - lo) * docs).reshape(hi - lo, docs)
            self.read += int(count.sum())
            part = which[lo:hi]
            for site, mine in self.sites.items():
                inside = np.isin(part, mine)
                if inside.any():
                    host = col["host"]
                    ok = pc.or_(pc.equal(host, site), pc.ends_with(host, "." + site)) \
                        .fill_null(False).to_numpy(zero_copy_only=False)
                    scores[np.ix_(inside, ~ok)] = 0.0
            self.best.offer(scores.T, col["id"], part)
            lo = hi

    def rows(self):
        return self.best.rows(self.ids, self.names)


def score(queries: DataFrame, blocks: DataFrame, k: int, id_type: T.DataType, *, query_id: str,
          doc_id: str, k1: float, b: float, margin: float) -> DataFrame:
    """(query_id, doc_id, raw): each task's rows within ``margin`` of the top-k
    of ``queries`` (id, site, terms, avgdl)."""
    schema = T.StructType([T.StructField(query_id, queries.schema["id"].dataType),
                           T.StructField(doc_id, id_type), T.StructField("raw", T.DoubleType())])
    names = schema.names
    return grid(packed(queries, QUERY_ROWS), blocks,
                lambda block: Scorer(block, k, k1, b, margin, names), schema)
