"""Manifest of an object prefix (R4): what was ingested, and what changed since.

A manifest is one row per object: uri, length, modified and the SHA-256 of its
bytes, kept as committed versions beside the mapping store. ``changes`` compares
it with a listing by one full join on the uri: an object is ``new``, ``deleted``,
a ``candidate`` when length or time differ, else ``same``. Only new objects and
candidates are opened; a candidate whose digest is the stored one was merely
touched. A restored object with an older time is a candidate like any other.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import DEFAULT_EXTENSIONS, list_files, read_corpus
from .mapping import load_version, save_version

MANIFEST_SCHEMA = T.StructType([
    T.StructField("uri", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("modified", T.TimestampType()), T.StructField("digest", T.StringType())])
NEW, CANDIDATE, CHANGED, DELETED, SAME = "new", "candidate", "changed", "deleted", "same"
# Paths named in one read: what the driver holds of an increment at a time.
PATHS = 10_000


def load_manifest(spark: SparkSession, base: str) -> DataFrame:
    return load_version(spark, base, MANIFEST_SCHEMA)


def changes(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(uri, status, length, modified, digest): every object of either side;
    length and modified of the listing where it has the object, the stored
    digest. With a ``digest`` in the listing, candidates are decided at once:
    ``changed`` if it differs, else ``same``."""
    decided = "digest" in listing.columns
    cols = [F.col("uri"), F.col("length").alias("_l"), F.col("modified").alias("_m")]
    now = listing.select(*cols, *([F.col("digest").alias("_d")] if decided else []), F.lit(True).alias("_now"))
    both = manifest.withColumn("_old", F.lit(True)).join(now, "uri", "full")
    moved = ~(F.col("length").eqNullSafe(F.col("_l")) & F.col("modified").eqNullSafe(F.col("_m")))
    differs = moved & ~F.col("digest").eqNullSafe(F.col("_d")) if decided else moved
    status = (F.when(F.col("_old").isNull(), NEW).when(F.col("_now").isNull(), DELETED)
              .when(differs, CHANGED if decided else CANDIDATE).otherwise(SAME))
    return both.select("uri", status.alias("status"), F.coalesce("_l", "length").alias("length"),
                       F.coalesce("_m", "modified").alias("modified"), "digest")


def opened(spark: SparkSession, root: str, wanted: DataFrame, whole: bool,
           exts: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """(uri, content, length, modified, digest) of the ``wanted`` uris; of every
    object below ``root`` when ``whole``. No other object is opened."""
    digest = F.sha2("content", 256).alias("digest")
    if whole:
        return read_corpus(spark, root, exts).select("*", digest)
    out, uris = None, (r["uri"] for r in wanted.select("uri").toLocalIterator())
    while block := list(islice(uris, PATHS)):
        # the paths are names, not patterns
        names = [re.sub(r"([\[\]{}*?,\\])", r"\\\1", u) for u in block]
        part = spark.read.format("binaryFile").load(names).select(
            F.col("path").alias("uri"), "content", "length",
            F.col("modificationTime").alias("modified"), digest)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "uri string, content binary, length bigint, "
                                        "modified timestamp, digest string")
    return out


def scan(spark: SparkSession, root: str, base: str,
         exts: tuple[str, ...] = DEFAULT_EXTENSIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare ``root`` with the manifest at ``base``: (changed, files, manifest).
    ``changed`` is (uri, status) of objects new, changed or deleted, ``files`` the
    content of the first two, ``manifest`` the next one, to be saved once the
    increment is stored (a crash before that repeats the increment)."""
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    old = load_manifest(spark, base)
    found = changes(old, list_files(spark, root, exts)).checkpoint()
    read = opened(spark, root, found.where(F.col("status").isin(NEW, CANDIDATE)), old.isEmpty(), exts)
    # the bytes are digested once; the contents kept are those that differ
    known = found.select("uri", F.col("status").alias("_s"), F.col("digest").alias("_d"))
    read = read.join(known, "uri").where(F.col("_s").isin(NEW, CANDIDATE)).checkpoint()
    fresh = (F.col("_s") == NEW) | ~F.col("digest").eqNullSafe(F.col("_d"))
    files = read.where(fresh).select("uri", "content", "length", "modified", "digest")
    changed = read.where(fresh).select("uri", F.when(F.col("_s") == NEW, NEW).otherwise(CHANGED).alias("status")) \
        .unionAll(found.where(F.col("status") == DELETED).select("uri", "status"))
    manifest = found.where(F.col("status") == SAME).select(*MANIFEST_SCHEMA.names) \
        .unionAll(read.select(*MANIFEST_SCHEMA.names))
    return changed, files, manifest


def save_manifest(manifest: DataFrame, base: str) -> str:
    return save_version(manifest.select(*MANIFEST_SCHEMA.names), base)
