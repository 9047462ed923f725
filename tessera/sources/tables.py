"""Readers for the driver tables (Parquet, one file per table).

Only the columns a query selects are read: Catalyst prunes the Parquet
``ReadSchema`` and pushes filters into the scan, so readers return the plain
relation and leave projection to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


# Tables whose rows carry long texts processed per row (regex cleaning,
# tokenising, hashing): CPU-bound work that needs every core.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over ``2 x defaultParallelism`` partitions when it
    has fewer partitions than cores (e.g. one large row group), so per-row
    text work is not serialised on one task. A scan of many files already
    has enough partitions and is left as is (no extra shuffle)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(2 * par)
    return df


def read_text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table about to get per-row text work (cleaning, chunking,
    tokenising, HTML): spread over the cores when the scan is too narrow.
    Column pruning and filters still reach the scan below the repartition."""
    return spread(read_table(spark, sf_dir, name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name == "events":
        # stored as TIMESTAMP_NTZ; event-time operators need TIMESTAMP
        # (session zone is UTC, so the wall-clock value is kept)
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df
