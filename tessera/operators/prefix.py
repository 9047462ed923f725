"""Running (prefix) aggregates per key without one task per key.

A window ``partitionBy(key).orderBy(pos)`` puts every row of a key into one
task; when one key holds a third of the rows, that task does a third of the
work. Here positions are cut into blocks of ``block`` consecutive values:
the running value inside a block is a window over (key, block), and the
carry-in from earlier blocks is a prefix over one summary row per
(key, block) -- a table whose size is the key's span divided by ``block``,
not its row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)).cast("bigint"))


def running_sum(df: DataFrame, key: list[str], pos: str, value: Column, out: str,
                tiebreak: list[str] = (), block: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = sum of ``value`` over the key's rows up to and including
    this one, in (pos, *tiebreak) order."""
    d = _blocked(df.withColumn("_v", value), pos, block)
    w_in = (Window.partitionBy(*key, "_blk").orderBy(pos, *tiebreak)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_in", F.sum("_v").over(w_in))
    tot = d.groupBy(*key, "_blk").agg(F.sum("_v").alias("_tot"))
    w_pre = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_carry", F.coalesce(F.sum("_tot").over(w_pre), F.lit(0)))
    return (d.join(tot.select(*key, "_blk", "_carry"), [*key, "_blk"])
            .withColumn(out, F.col("_carry") + F.col("_in"))
            .drop("_blk", "_v", "_in", "_carry"))


def running_last(df: DataFrame, key: list[str], pos: str, value: Column, out: str,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = the last non-null ``value`` at or before this row's
    position within its key (positions unique per key)."""
    d = _blocked(df.withColumn("_v", value), pos, block)
    w_in = (Window.partitionBy(*key, "_blk").orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_in", F.last("_v", ignorenulls=True).over(w_in))
    tot = d.groupBy(*key, "_blk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_blk_last"))
    w_pre = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_carry", F.last("_blk_last", ignorenulls=True).over(w_pre))
    return (d.join(tot.select(*key, "_blk", "_carry"), [*key, "_blk"])
            .withColumn(out, F.coalesce(F.col("_in"), F.col("_carry")))
            .drop("_blk", "_v", "_in", "_carry"))
