"""Helpers shared by the operators: staged tables, and vectorised views of
Arrow text columns (bytes, words, word hashes) for the map-side Python steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import staging_path

# [\x20\x09-\x0D] of the contracts.
SPACES = "[\\x20\\x09-\\x0D]+"


# Rows of one Arrow batch: with texts of a few KB, some MB a batch.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Cap the rows of the Arrow batches sent to Python workers: a batch is held
    whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, fixes row order."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_chosen(docs: DataFrame, chosen: DataFrame, key, id_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``chosen`` (id, key, n: rows of that name),
    a repeated row once, all columns kept. ``key`` is the key's expression."""
    names = chosen.select(F.col("id").alias("__row_id"), F.col("key").alias("__row_k"),
                          F.col("n").alias("__row_n"))
    rows = docs.withColumn("__row_key", key).join(
        names, F.col(id_col).eqNullSafe(F.col("__row_id")) & (F.col("__row_key") == F.col("__row_k")))
    once = rows.where("__row_n = 1").select(docs.columns)
    again = rows.where("__row_n > 1").dropDuplicates(["__row_id", "__row_k"]).select(docs.columns)
    return once.unionAll(again)


def label_fold(modulus: int, remainder: int, id_col: str = "doc_id"):
    """True where crc32(id as text) mod ``modulus`` equals ``remainder``; a
    null id counts as the empty text."""
    c = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (c % modulus) == remainder


# --- Arrow text columns as numpy arrays -----------------------------------

def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and their offsets (len + 1); null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or
                            pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32,
                        len(col) + 1 + col.offset)[col.offset:].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else \
        np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text_col: str,
           max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of text (one text
    longer than that stands alone): bounds the numpy working set."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = utf8(b.column(b.schema.get_field_index(text_col)))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Letter bytes: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SOLID = ~_WS
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2 ** 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2 ** 64, dtype=np.uint64)) | 5
_INV = pow(_BASE, -1, 2 ** 64)
_pow = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("f", ())) < n + 1:
        size = 1 << max(16, int(n + 1).bit_length())
        for name, base in (("f", _BASE), ("i", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["f"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end) (a polynomial over random
    byte codes, from one running sum), independent of where it stands."""
    f, i = _powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * f[:len(data)], out=run[1:])
    return mix((run[end] - run[start]) * i[start] + (end - start).astype(np.uint64))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` consecutive words, from their hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    f, i = _powers(len(h))
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * f[:len(h)], out=run[1:])
    return (run[n:] - run[:-n]) * i[:len(h) - n + 1]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column: byte spans, the
    first word of each row (``first``, len + 1), A-Z lower-cased. ``kind`` is
    the table of the bytes that words consist of."""

    def __init__(self, col: pa.Array, kind: np.ndarray = SOLID):
        data, off = utf8(col)
        data = LOWER[data]
        solid = kind[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        before[edge[:n]] = False
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        after[edge[1:]] = False
        self.data, self.off = data, off
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
