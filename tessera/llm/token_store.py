"""Token-id files: canonical length-limited Huffman coding.

Texts are tokenised once into a written table of ids. Their counts (a sum per
id) give code lengths of at most ``LIMIT`` bits by package-merge; codes are
canonical, so the code book is one length per id. The ids are coded where they
are read; only coded bytes are shuffled into ranges of the document id.

A file holds independent blocks, one row each: ``bucket`` (range of ids, in
order), ``block``, and ``data``:

    b"THB1", docs, ids, checkpoint interval, start (ids before it in the bucket)
    docs x (id int64, null flag u8, n_ids u32, coded bytes u32)
    u32 bit offsets within the document of every ``EVERY``-th id
    coded bytes; each document begins on a byte

A block decodes alone, given the code book: one lane per checkpoint, all lanes
in step, each step one table lookup of the next ``LIMIT`` bits.

Documents stand in ascending id order (null ids first; equal ids in an
arbitrary but fixed order). Buckets come from quantiles of the ids; where one id
fills several, its rows are dealt over them by a hash of the text. Every worker
holds one slice of texts or one block.

Defined cases: null text is the end id alone; repeated rows are each written; an
empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import staging_path

from .base import slices, staged, utf8
from .tokens import encoder, vocabulary

LIMIT = 16
EVERY = 256
BLOCK_BYTES = 1 << 20
_HEAD = struct.Struct("<4sIQIQ")
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4"), ("size", "<u4")])


# --- the code ---------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for
    ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        pairs = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, pairs])
        o = np.argsort(both, kind="stable")
        merged, is_leaf = both[o], o < n
    levels.append(is_leaf)
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        c = int(is_leaf[:take].sum())
        out[:c] += 1
        take = 2 * (take - c)
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    step = 1 << (LIMIT - size)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (np.cumsum(step) - step) >> (LIMIT - size)
    return codes


class Book:
    """Code book: lengths and codes by id, and the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes = canonical_codes(lengths)

    def table(self):
        sym = np.zeros(1 << LIMIT, np.uint32)
        size = np.ones(1 << LIMIT, np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        width = 1 << (LIMIT - self.lengths[order].astype(np.int64))
        full = np.repeat(order, width)
        sym[:len(full)], size[:len(full)] = full, self.lengths[full]
        return sym, size

    def encode(self, ids: np.ndarray, first: np.ndarray):
        """Coded bytes of each row's ids, the rows' byte offsets, and the bit
        offset of every id within its row."""
        bits = self.lengths[ids].astype(np.int64)
        run = np.concatenate([[0], np.cumsum(bits)])
        size = -(-(run[first[1:]] - run[first[:-1]]) // 8)
        byte = np.concatenate([[0], np.cumsum(size)])
        rel = run[:-1] - np.repeat(run[first[:-1]], np.diff(first))
        at = rel + np.repeat(byte[:-1] * 8, np.diff(first))
        v = self.codes[ids].astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)
        words = -(-int(byte[-1]) // 4) + 2
        w = at >> 5
        # codes do not overlap: the sums are exact and stay below 2^32
        out = np.bincount(w, (v >> np.uint64(32)).astype(np.float64), words) \
            + np.bincount(w + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        return out.astype(np.uint64).astype(">u4").tobytes()[:byte[-1]], byte, rel


def encode_block(rows: list, start: int) -> tuple[bytes, int]:
    """A block of (id, ids, checkpoints, coded bytes) rows, and its ids."""
    doc = np.array([(i or 0, i is None, n, len(d)) for i, n, _, d in rows], _DOC)
    ids = int(doc["n"].sum())
    return b"".join([_HEAD.pack(b"THB1", len(doc), ids, EVERY, start), doc.tobytes(),
                     *(m for _, _, m, _ in rows), *(d for *_, d in rows)]), ids


def decode_block(data: bytes, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(documents, ids, first id of each document, start) of a block."""
    magic, docs, ids, every, start = _HEAD.unpack_from(data)
    if magic != b"THB1":
        raise ValueError("not a token block")
    doc = np.frombuffer(data, _DOC, docs, _HEAD.size)
    n = doc["n"].astype(np.int64)
    lanes = -(-n // every)
    at = _HEAD.size + docs * _DOC.itemsize
    marks = np.frombuffer(data, "<u4", int(lanes.sum()), at).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=at + 4 * len(marks))
    b = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    word = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    byte = np.cumsum(doc["size"].astype(np.int64)) - doc["size"]
    first = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(docs), lanes)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    bit = marks + byte[of] * 8
    to = first[of] + nth * every
    left = np.minimum(every, n[of] - nth * every)
    out = np.zeros(ids, np.uint32)
    o = np.argsort(-left, kind="stable")           # lanes that end early drop off the end
    bit, to, left = bit[o], to[o], left[o]
    sym, size = table
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k, "left"))
        p = bit[:m]
        c = (word[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[to[:m] + k] = sym[c]
        bit[:m] += size[c]
    return doc, out, first, start


# --- the Spark job ------------------------------------------------------------

def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Staged (id, k, h, n, ids) of whole texts: k orders the ids, h is a hash
    of the text, ids are little-endian u16 or, for large vocabularies, u32."""
    def run(batches):
        enc = encoder(path)
        kind = np.dtype("<u2" if enc.size <= 1 << 16 else "<u4")
        for b in slices(batches, "text"):
            ids, first = enc.encode(b.column("text"))
            raw, w = ids.astype(kind).tobytes(), kind.itemsize
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("k"), b.column("h"), pa.array(np.diff(first)),
                 pa.array([raw[w * s:w * e] for s, e in zip(first, first[1:])], pa.binary())],
                ["id", "k", "h", "n", "ids"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-2 ** 63)).alias("k"),
        F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "id long, k long, h long, n long, ids binary"),
                  "token-ids")


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a staged batch and their offsets."""
    data, off = utf8(b.column("ids"))
    first = np.concatenate([[0], np.cumsum(b.column("n").to_numpy())])
    wide = first[-1] and off[-1] // first[-1] == 4
    return np.frombuffer(data.tobytes(), "<u4" if wide else "<u2").astype(np.uint32), first


def token_counts(rows: DataFrame) -> np.ndarray:
    """Count of every id over all texts, the end ids included."""
    def counted(batches):
        total = np.zeros(0, np.int64)
        for b in slices(batches, "ids"):
            n = np.bincount(_ids(b)[0], minlength=len(total))
            n[:len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "n"])

    found = rows.select("n", "ids").mapInArrow(counted, "t long, n long") \
        .groupBy("t").agg(F.sum("n").alias("n")).collect()     # at most one row per id
    counts = np.zeros(max([r["t"] for r in found], default=0) + 1, np.int64)
    for r in found:
        counts[r["t"]] = r["n"]
    return counts


def _bucket(docs: DataFrame, buckets: int):
    """Range of the id column ``k``; an id that fills several is dealt over
    them by the hash ``h`` of its text."""
    q = [i / buckets for i in range(1, buckets)]
    row = docs.select(F.percentile_approx("k", q, 100_000).alias("q")).first() if q else None
    cuts = list(row["q"] or []) if row else []
    if not cuts:
        return F.lit(0)
    marks = F.lit(np.array(cuts, dtype=np.int64).tolist())
    below = F.size(F.filter(marks, lambda c: c < F.col("k")))
    same = F.size(F.filter(marks, lambda c: c == F.col("k")))
    return (below + F.pmod("h", same + 1)).cast("int")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> Book:
    """Tokenise ``docs`` and write the store's blocks under ``path``/blocks and
    its code book under ``path``/book."""
    spark = docs.sparkSession
    vocab = vocabulary(tokenizer)
    rows = tokenised(docs, vocab, id_col, text_col)
    book = Book(code_lengths(token_counts(rows)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", _bucket(rows, buckets))

    def coded(batches):
        for b in slices(batches, "ids"):
            ids, first = _ids(b)
            data, byte, rel = book.encode(ids, first)
            n = np.diff(first)
            marks = [rel[s:e:EVERY].astype("<u4").tobytes() for s, e in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("bucket"), b.column("k"), b.column("id"), pa.array(n),
                 pa.array(marks, pa.binary()),
                 pa.array([data[s:e] for s, e in zip(byte, byte[1:])], pa.binary())],
                ["bucket", "k", "id", "n", "marks", "data"])

    def blocks(batches):
        held, size, at = [], 0, (None, 0, 0)        # (bucket, block, ids before)

        def flush():
            nonlocal held, size, at
            bucket, block, start = at
            blob, ids = encode_block(held, start)
            held, size, at = [], 0, (bucket, block + 1, start + ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([ids], pa.int64()), pa.array([blob], pa.binary())],
                ["bucket", "block", "ids", "data"])

        for b in slices(batches, "data"):
            for bucket, i, n, m, d in zip(*(b.column(x).to_pylist() for x in
                                            ("bucket", "id", "n", "marks", "data"))):
                if held and (bucket != at[0] or size >= BLOCK_BYTES):
                    yield flush()
                if bucket != at[0]:
                    at = (bucket, 0, 0)
                held.append((i, n, m, d))
                size += len(d)
        if held:
            yield flush()

    rows.mapInArrow(coded, "bucket int, k long, id long, n long, marks binary, data binary") \
        .repartition(buckets, "bucket").sortWithinPartitions("bucket", "k", "n", "data") \
        .mapInArrow(blocks, "bucket int, block int, ids long, data binary") \
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytes(book.lengths),)], "lengths binary").coalesce(1) \
        .write.parquet(f"{path}/book")
    return book


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: id, start (ids of all documents before it),
    n_tokens, ids (little-endian u32, the end id included)."""
    lengths = spark.read.schema("lengths binary").parquet(f"{path}/book").first()["lengths"]
    book = Book(np.frombuffer(bytes(lengths), np.uint8))
    stored = spark.read.schema("bucket int, block int, ids long, data binary") \
        .parquet(f"{path}/blocks")
    # one row per bucket: as many as the store has partitions
    sums = stored.groupBy("bucket").agg(F.sum("ids").alias("n")).orderBy("bucket").collect()
    base, run = {}, 0
    for r in sums:
        base[r["bucket"]], run = run, run + r["n"]

    def decoded(batches):
        table = book.table()
        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data")):
                doc, ids, first, start = decode_block(data.as_py(), table)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc["id"].astype(np.int64), mask=doc["null"].astype(bool)),
                     pa.array(first[:-1] + start + base[bucket]), pa.array(np.diff(first)),
                     pa.array([raw[4 * s:4 * e] for s, e in zip(first, first[1:])],
                              pa.binary())], ["id", "start", "n_tokens", "ids"])

    return stored.select("bucket", "data").mapInArrow(
        decoded, "id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Write ``docs`` to a store under the shared folder and read it back."""
    path = staging_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, id_col, text_col)
    return read_store(docs.sparkSession, path).withColumnRenamed("id", id_col)
