"""Mapping store (S5, S6, S7): ``chunk_id -> (source, chunk_index, text)``.

The store is a folder of immutable versions ``v000001``, ``v000002``, ...
Saving writes the next version beside the current one (Spark cannot
overwrite a path it is reading from) and a reader takes the newest version
whose write committed (``_SUCCESS`` present). A missing store reads as
empty; an unreadable version raises instead of silently becoming empty,
because the next save would then drop every earlier row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAPPING_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("chunk_index", T.IntegerType(), True),
    T.StructField("text", T.StringType(), True),
])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, base: str, complete: bool = True) -> list[str]:
    """Version folders of a store, oldest first; only committed ones unless
    ``complete`` is off."""
    fs, p, jvm = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v") and name[1:].isdigit():
            if not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(name)
    return sorted(out)


def load_version(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """The newest committed version of a store, empty if it has none."""
    vs = versions(spark, base)
    if not vs:
        return spark.createDataFrame([], schema)
    # schema enforced: a version written with other columns fails here
    return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{vs[-1]}")


def save_version(df: DataFrame, base: str) -> str:
    """Write ``df`` as the next version of a store; returns its path."""
    # past any folder, also one a crashed write has left
    nxt = max((int(v[1:]) for v in versions(df.sparkSession, base, complete=False)), default=0) + 1
    path = f"{base.rstrip('/')}/v{nxt:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_mapping(spark: SparkSession, base: str) -> DataFrame:
    return load_version(spark, base, MAPPING_SCHEMA)


def save_mapping(df: DataFrame, base: str) -> str:
    """Write ``df`` as the next version; returns its path."""
    return save_version(df.select([f.name for f in MAPPING_SCHEMA.fields]), base)


def export_mapping_json(df: DataFrame, path: str) -> None:
    """JSON export, one object per line: {chunk_id, source, chunk_index,
    text}; non-ASCII kept as is. Written by every task in parallel -- the
    single-object form of the reference would pass the whole mapping
    through one task."""
    df.select("chunk_id", "source", "chunk_index", "text").write.mode("overwrite").json(path)


# --- partitioned store: increments rewrite only the partitions they touch ---

PARTITIONED_SCHEMA = T.StructType(MAPPING_SCHEMA.fields + [T.StructField("part", T.IntegerType())])

def _exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def _check_parts(spark: SparkSession, base: str, n_parts: int, part) -> None:
    """The store's number of partitions is kept in it, as the name of an empty
    file ``_n_parts.N``; a store without one is looked through once."""
    fs, p, jvm = _fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    stored = [int(n.split(".")[1]) for n in names if n.startswith("_n_parts.")]
    if stored:
        if stored[0] != n_parts:
            raise ValueError(f"{base} was written with n_parts {stored[0]}, not {n_parts}")
        return
    if names:
        rows = spark.read.schema(PARTITIONED_SCHEMA).parquet(base)
        if not rows.where(F.col("part") != part).select("part").limit(1).isEmpty():
            raise ValueError(f"{base} was written with another n_parts than {n_parts}")
    fs.mkdirs(p)
    fs.createNewFile(jvm.org.apache.hadoop.fs.Path(p, f"_n_parts.{n_parts}"))


def upsert_partitioned(new: DataFrame, base: str, n_parts: int = 256,
                       prune_stale: bool = False) -> list[int]:
    """Keyed upsert (by ``chunk_id``) into a mapping table partitioned by
    ``part = hash(source) mod n_parts``. Chunk ids are uniformly spread, but
    a re-ingested object's chunks share its ``source``, so an increment
    touches few partitions: only those are read, merged and rewritten
    (dynamic partition overwrite); every other partition stays as written.
    The merged partitions are first staged in the shared checkpoint folder
    (a path cannot be overwritten by a job that reads it). Returns the
    partitions rewritten."""
    from ..operators.upsert import merge
    from ..session import staging_path

    spark = new.sparkSession
    cols = [f.name for f in MAPPING_SCHEMA.fields]
    part = F.pmod(F.xxhash64("source"), F.lit(n_parts)).cast("int")
    new_p = new.select(*cols).withColumn("part", part)
    _check_parts(spark, base, n_parts, part)
    touched = sorted(r["part"] for r in new_p.select("part").distinct().collect())  # <= n_parts
    if touched:
        old = (spark.read.schema(PARTITIONED_SCHEMA).parquet(base)
               .where(F.col("part").isin(touched)))                  # partition pruning
        merged = merge(old, new_p, prune_stale=prune_stale)
    else:
        merged = new_p
    stage = staging_path(spark, "mapping-stage")
    merged.write.partitionBy("part").parquet(stage)
    key = "spark.sql.sources.partitionOverwriteMode"
    prev = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        (spark.read.parquet(stage).select(*cols, "part")
         .write.mode("overwrite").partitionBy("part").parquet(base))
    finally:
        spark.conf.set(key, prev)
    return touched


def _swapped(spark: SparkSession, path: str):
    """(fs, path, old, next): the places of a table that is replaced whole. A
    swap cut short is mended: the old rows return unless the new are in place."""
    fs, p, jvm = _fs(spark, path.rstrip("/"))
    beside = [jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.{x}") for x in ("old", "next")]
    if fs.exists(beside[0]):
        if fs.exists(p):
            fs.delete(beside[0], True)
        else:
            fs.rename(beside[0], p)
    return fs, p, *beside


def load_datapoints(spark: SparkSession, path: str) -> DataFrame | None:
    """The datapoint table, also after a replacement that was cut short; None if
    there is none."""
    fs, p, _, _ = _swapped(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None


def save_datapoints(new: DataFrame, path: str, key: str = "datapoint_id",
                    drop: DataFrame | None = None) -> None:
    """Insert or replace datapoints by id: the rows of ``new`` (one of each id)
    take the place of stored ones; those whose id is in ``drop`` go. The next
    table is written beside the stored one, then both are renamed, so that at
    every moment one of them is whole."""
    from ..operators.upsert import merge

    spark = new.sparkSession
    new = new.dropDuplicates([key])
    stored = load_datapoints(spark, path)
    if stored is not None:
        if drop is not None:
            stored = stored.join(drop.select(key), key, "left_anti").select(stored.columns)
        new = merge(stored, new, key=key)
    fs, p, old, nxt = _swapped(spark, path)
    new.write.mode("overwrite").parquet(nxt.toString())
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(nxt, p)
    fs.delete(old, True)


def load_partitioned(spark: SparkSession, base: str) -> DataFrame:
    """The partitioned mapping table (empty if absent)."""
    if not _exists(spark, base):
        return spark.createDataFrame([], MAPPING_SCHEMA)
    return spark.read.schema(PARTITIONED_SCHEMA).parquet(base).select(
        *[f.name for f in MAPPING_SCHEMA.fields])
