"""Deterministic identifiers: corpus namespace, chunk keys, UUIDv5.

The UUIDv5 is computed with built-ins only (sha1 over namespace bytes +
UTF-8 key, then the version and variant nibbles), so re-runs give the same id
without a Python worker.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CHUNK_KEY_SEPARATOR = "::chunk::"   # key = "{uri}::chunk::{index}"
UUID_VERSION_NIBBLE = "5"           # name-based, SHA-1
UUID_VARIANT_NIBBLES = "89ab"       # RFC 4122 variant: top bits 10
# ----------------------------------------------------------------------------


def namespace_hex(prefix: str) -> str:
    """32 hex digits: the first half of SHA-256(prefix), used as UUID bits
    (X3). Computed once per ingest run from its prefix argument."""
    return hashlib.sha256(prefix.encode("utf-8")).hexdigest()[:32]



def chunk_key(uri: Column, index: Column) -> Column:
    """``{uri}::chunk::{i}``."""
    return F.concat(uri, F.lit(CHUNK_KEY_SEPARATOR), index.cast("string"))


def uuid5_digest(ns_hex: Column | str, key: Column) -> Column:
    """SHA-1 hex digest of namespace bytes + UTF-8 key (input of UUIDv5)."""
    ns = F.lit(ns_hex) if isinstance(ns_hex, str) else ns_hex
    return F.sha1(F.concat(F.unhex(ns), F.encode(key, "UTF-8")))


def uuid5(ns_hex: Column | str, key: Column) -> Column:
    """UUIDv5 of ``key`` in namespace ``ns_hex`` (32 hex digits)."""
    return uuid5_from_digest(uuid5_digest(ns_hex, key))


def uuid5_column(df: DataFrame, ns_hex: Column | str, key: Column, out: str) -> DataFrame:
    """Add UUIDv5 column ``out``; the digest is computed once per row (a
    separate projection, which Catalyst keeps since it is used 7 times)."""
    tmp = f"_{out}_sha1"
    return (df.withColumn(tmp, uuid5_digest(ns_hex, key))
            .withColumn(out, uuid5_from_digest(F.col(tmp))).drop(tmp))


def uuid5_from_digest(h: Column) -> Column:
    """Format a SHA-1 hex digest as a version-5 UUID string."""
    variant = F.substr(
        F.lit(UUID_VARIANT_NIBBLES),
        (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1,
        F.lit(1),
    )
    return F.concat(
        F.substr(h, F.lit(1), F.lit(8)), F.lit("-"),
        F.substr(h, F.lit(9), F.lit(4)), F.lit("-"),
        F.lit(UUID_VERSION_NIBBLE), F.substr(h, F.lit(14), F.lit(3)), F.lit("-"),
        variant, F.substr(h, F.lit(18), F.lit(3)), F.lit("-"),
        F.substr(h, F.lit(21), F.lit(12)),
    )
