"""Corpus -> chunk table.

Map-only: scan, clean, split into overlapping character windows, assign
deterministic ids. No shuffle.

The windows are cut from fixed pieces of ``step = chunk - overlap``
characters (one regex pass over the text), each window being the
concatenation of the next ``ceil(chunk / step)`` pieces trimmed to ``chunk``
characters. A code-point substring at offset ``i`` costs O(i), so cutting
windows directly from a long text would be quadratic in its length; the
piece form keeps the work linear, and the generated rows never carry the
full text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import _let
from ..functions.ids import chunk_key, namespace_hex, uuid5_column
from ..functions.text import (DEFAULT_CHUNK_CHARS, DEFAULT_CHUNK_OVERLAP,
                              chunk_count, clean_text, validate_chunking)

# --- fixed values -----------------------------------------------------------
CORPUS_PREFIX = "gs://corpus/"   # object prefix the driver `documents` map to
# ----------------------------------------------------------------------------


def corpus_uri(source: Column, doc_id: Column, prefix: str = CORPUS_PREFIX) -> Column:
    """Object URI a `documents` row stands for: ``{prefix}{source}/{doc_id}.txt``."""
    return F.concat(F.lit(prefix), source, F.lit("/"), doc_id.cast("string"),
                    F.lit(".txt"))


def chunk_pieces(clean: Column, chunk: int, overlap: int) -> Column:
    """Consecutive pieces of ``max(chunk - overlap, 1)`` characters."""
    validate_chunking(chunk, overlap)
    step = max(chunk - overlap, 1)
    return F.regexp_extract_all(clean, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))


def chunk_windows(pieces: Column, n_chars: Column, chunk: int, overlap: int) -> Column:
    """``ARRAY<STRING>`` of the windows of a cleaned text of ``n_chars``
    characters, given its :func:`chunk_pieces` (a column, computed once)."""
    step = max(chunk - overlap, 1)
    per = math.ceil(chunk / step)
    count = chunk_count(n_chars, chunk, overlap)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))
    # ``pieces`` is bound once: an expression passed in is not re-evaluated
    # per window
    return _let(pieces, lambda ps: F.transform(
        starts,
        lambda i: F.substr(F.array_join(F.slice(ps, i + 1, F.lit(per)), ""),
                           F.lit(1), F.lit(chunk))))


def chunk_table(df: DataFrame, uri_col: str, text_col: str,
                prefix: str = CORPUS_PREFIX,
                chunk: int = DEFAULT_CHUNK_CHARS,
                overlap: int = DEFAULT_CHUNK_OVERLAP,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunks(chunk_id, source, chunk_index, text)`` (+ ``keep`` columns).

    Texts that are empty after cleaning contribute no chunk (F3). Ids are
    UUIDv5 of ``"{uri}::chunk::{i}"`` in the namespace derived from
    ``prefix``: reruns give the same ids, and an id depends on position.
    """
    ns = namespace_hex(prefix)
    cleaned = df.select(*keep, F.col(uri_col).alias("source"),
                        clean_text(F.col(text_col)).alias("_clean"))
    pieces = cleaned.select(*keep, "source",
                            F.length("_clean").alias("_n"),
                            chunk_pieces(F.col("_clean"), chunk, overlap).alias("_pieces"))
    exploded = pieces.select(
        *keep, "source",
        F.posexplode(chunk_windows(F.col("_pieces"), F.col("_n"), chunk, overlap))
        .alias("chunk_index", "text"))
    return uuid5_column(exploded, ns, chunk_key(F.col("source"), F.col("chunk_index")),
                        "chunk_id").select(
        "chunk_id", "source", F.col("chunk_index").cast("int").alias("chunk_index"),
        "text", *keep)


def corpus_chunks(documents: DataFrame, prefix: str = CORPUS_PREFIX,
                  chunk: int = DEFAULT_CHUNK_CHARS,
                  overlap: int = DEFAULT_CHUNK_OVERLAP, sources: DataFrame | None = None) -> DataFrame:
    """Chunk the driver ``documents`` table as objects under ``prefix``; with
    ``sources`` (column ``source``: URIs) only those objects."""
    docs = documents.select(
        corpus_uri(F.col("source"), F.col("doc_id"), prefix).alias("uri"), "text")
    if sources is not None:
        docs = docs.join(sources.select(F.col("source").alias("uri")), "uri", "left_semi")
    return chunk_table(docs, "uri", "text", prefix, chunk, overlap)
