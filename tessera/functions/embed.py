"""Hashed bag-of-words embedding.

A text becomes a sparse vector over ``dim`` buckets: lower-case, split into
letter/digit runs, bucket = first 32 bits of md5(token) mod dim, value = term
count. The L2-normalised form is the dense ``feature_vector``.

Counts stay integers so a dot product between two such vectors is an exact
integer in every engine; ``dot / (sqrt(ss_a) * sqrt(ss_b))`` is then
bit-identical in Spark, NumPy and SQL (sqrt, * and / are correctly rounded).

Everything is computed per row with built-in higher-order functions: no
shuffle, no Python worker. A model embedder can replace it through
:func:`embed_with` (a pandas UDF hook).
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}]+"    # letter/digit runs; same in Java and RE2
DEFAULT_DIM = 768                   # one of the dimensions the reference names
# ----------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                F.lit(TOKEN_PATTERN), F.lit(0))


def bucket_of(token: Column, dim: int) -> Column:
    h = F.conv(F.substr(F.md5(token), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return (h % F.lit(dim)).cast("int")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst substitutes projected aliases into pushed-down filters and
    collapsed projections; nesting array expressions through plain columns
    can then re-evaluate an inner array per element of an outer one. A
    lambda variable is never inlined, so each value is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sparse_tf(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``STRUCT<buckets ARRAY<INT> (ascending), tfs ARRAY<INT>, ss BIGINT>``:
    hashed term counts of ``text`` and the sum of squared counts."""
    sorted_b = F.sort_array(F.transform(tokens(text), lambda tok: bucket_of(tok, dim)))

    def with_sorted(sb):
        n = F.size(sb)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
            F.array().cast("array<int>"))
        # 0-based positions where a run of equal buckets ends
        ends = F.filter(idx, lambda i: (i == n - 1) | (F.get(sb, i) != F.get(sb, i + 1)))

        def with_ends(e):
            tfs = F.transform(e, lambda x, j: x - F.coalesce(F.get(e, j - 1), F.lit(-1)))
            return _let(tfs, lambda t: F.struct(
                F.transform(e, lambda x: F.get(sb, x)).alias("buckets"),
                t.alias("tfs"),
                F.aggregate(t, F.lit(0).cast("bigint"),
                            lambda acc, x: acc + (x * x).cast("bigint")).alias("ss")))
        return _let(ends, with_ends)
    return _let(sorted_b, with_sorted)


_buckets: dict[tuple[str, int], int] = {}
MOST_BUCKETS = 1_000_000


def hashed_counts(toks: pa.Array, dim: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """:func:`sparse_tf` of a column of :func:`tokens` inside an Arrow task: a
    token's bucket is computed once a worker, not once an occurrence."""
    size = np.asarray(toks.value_lengths().fill_null(0), np.int64)
    flat = toks.flatten().dictionary_encode()
    if len(_buckets) > MOST_BUCKETS:
        _buckets.clear()
    found = []
    for word in flat.dictionary.to_pylist():
        bucket = _buckets.get((word, dim))
        if bucket is None:
            digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
            bucket = _buckets[word, dim] = int.from_bytes(digest[:4], "big") % dim
        found.append(bucket)
    row = np.repeat(np.arange(len(toks)), size)
    at = row * dim + np.array(found, np.int64)[np.asarray(flat.indices, np.int64)]
    held, counts = np.unique(at, return_counts=True)
    row = held // dim
    first = np.searchsorted(row, np.arange(len(toks) + 1))
    run = np.concatenate([[0], np.cumsum(counts * counts)])
    off = pa.array(first, pa.int32())
    return (pa.ListArray.from_arrays(off, pa.array(held % dim, pa.int32())),
            pa.ListArray.from_arrays(off, pa.array(counts, pa.int32())), pa.array(np.diff(run[first]), pa.int64()))


def term_counts(toks: Column) -> Column:
    """``STRUCT<terms ARRAY<STRING> (ascending), tfs ARRAY<INT>, dl INT>``:
    distinct tokens with their counts and the token count, per row."""
    def with_sorted(st):
        n = F.size(st)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
            F.array().cast("array<int>"))
        ends = F.filter(idx, lambda i: (i == n - 1) | (F.get(st, i) != F.get(st, i + 1)))
        return _let(ends, lambda e: F.struct(
            F.transform(e, lambda x: F.get(st, x)).alias("terms"),
            F.transform(e, lambda x, j: x - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("tfs"),
            n.alias("dl")))
    return _let(F.sort_array(toks), with_sorted)


def with_sparse_tf(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM,
                   prefix: str = "") -> DataFrame:
    """Add ``{prefix}buckets``, ``{prefix}tfs`` and ``{prefix}ss`` (see
    :func:`sparse_tf`)."""
    tmp = f"_{prefix}sv"
    return (df.withColumn(tmp, sparse_tf(F.col(text_col), dim))
            .withColumn(f"{prefix}buckets", F.col(f"{tmp}.buckets"))
            .withColumn(f"{prefix}tfs", F.col(f"{tmp}.tfs"))
            .withColumn(f"{prefix}ss", F.col(f"{tmp}.ss"))
            .drop(tmp))


def dense_vector(buckets: Column, tfs: Column, ss: Column, dim: int) -> Column:
    """``ARRAY<FLOAT>`` of length ``dim``: counts divided by the L2 norm."""
    m = F.map_from_arrays(buckets, tfs)
    norm = F.sqrt(ss.cast("double"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(norm > 0, F.coalesce(F.element_at(m, i), F.lit(0)) / norm)
        .otherwise(F.lit(0.0)).cast("float"))


def embed_with(df: DataFrame, text_col: str, out_col: str,
               embedder: Callable) -> DataFrame:
    """Apply a caller-supplied pandas UDF ``embedder`` (Series[str] ->
    Series[list[float]]) -- the hook for a real embedding model. Arrow
    batches bound the per-call size (spark.sql.execution.arrow.maxRecordsPerBatch)."""
    return df.withColumn(out_col, embedder(F.col(text_col)))
