"""Corpus pipeline over ``documents``: toxicity filter, exact dedup, near-dup
removal, benchmark decontamination, packing. Each stage is written as Parquet
and read back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tessera.llm import decontam, exact_dedup, minhash, packing, toxicity
from tessera.llm.base import bounded_batches, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a machine fitted on all labels."""
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="__toxicity").where("__toxicity < 0.5") \
        .drop("__toxicity")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 over five words."""
    bounded_batches(spark)
    return minhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents, their ids as a checksum."""
    bounded_batches(spark)
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies),
          ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark_leaks),
          ("packing", pack)]

#: No SQL for the model, the near-duplicate and the packing stages; the tests
#: hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
