"""Mapping store bucketed by object (J2, U1, S6): a merge shuffles the increment only.

Versions like those of :mod:`tessera.sources.mapping`, each written as a table
bucketed and sorted by ``source``. A chunk's id follows from its source and index,
so the keyed merge joins on (source, chunk_id) and the pruning one on the source;
the store's side of both comes from its buckets without an exchange. A version is
written beside the ones before it and counts once committed, so a killed write
leaves the old rows readable. The number of buckets is kept in the store, as the name
of an empty file ``_buckets.N``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .mapping import MAPPING_SCHEMA, _fs, versions

KEY = "source"


def stored_buckets(spark: SparkSession, base: str) -> int | None:
    fs, p, _ = _fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return next((int(n.split(".")[1]) for n in names if n.startswith("_buckets.")), None)


def load_bucketed(spark: SparkSession, base: str) -> DataFrame:
    """The newest version, its buckets known to the planner; empty if none."""
    vs, n = versions(spark, base), stored_buckets(spark, base)
    if not vs:
        return spark.createDataFrame([], MAPPING_SCHEMA)
    path = f"{base.rstrip('/')}/{vs[-1]}"
    # a name for this path, in the session's catalog only; the files are the store
    name = "tessera_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MAPPING_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def save_bucketed(df: DataFrame, base: str, buckets: int = 64) -> str:
    """Write ``df`` as the next version; returns its path."""
    spark = df.sparkSession
    fs, p, jvm = _fs(spark, base)
    n = stored_buckets(spark, base)
    if n not in (None, buckets):
        raise ValueError(f"{base} has {n} buckets, not {buckets}")
    fs.mkdirs(p)
    if n is None:
        fs.createNewFile(jvm.org.apache.hadoop.fs.Path(p, f"_buckets.{buckets}"))
    nxt = max((int(v[1:]) for v in versions(spark, base, complete=False)), default=0) + 1
    path, name = f"{base.rstrip('/')}/v{nxt:06d}", "tessera_" + uuid.uuid4().hex
    (df.select([f.name for f in MAPPING_SCHEMA.fields]).write.format("parquet")
     .bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")                  # external: the files stay
    return path


def merged(store: DataFrame, new: DataFrame, prune_stale: bool = False) -> DataFrame:
    """``store`` with ``new`` inserted or replaced; with ``prune_stale`` a
    re-ingested object's old chunks go."""
    on = [KEY] if prune_stale else [KEY, "chunk_id"]
    kept = store.join(new.select(on).distinct(), on, "left_anti")
    return kept.select(store.columns).unionByName(new.select(store.columns))


@contextmanager
def joined_in_buckets(spark: SparkSession) -> Iterator[None]:
    """Lets a join on the source and another key use the buckets by source; in
    force while a plan is made, restored after."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def upsert_bucketed(new: DataFrame, base: str, buckets: int = 64, prune_stale: bool = False) -> str:
    """Merge ``new`` into the store; returns the new version's path."""
    spark = new.sparkSession
    with joined_in_buckets(spark):
        return save_bucketed(merged(load_bucketed(spark, base), new, prune_stale), base, buckets)
