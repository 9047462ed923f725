"""Exact deduplication by distributed MSD radix partitioning.

Normalised texts are split by successive byte windows. In each round a row's
key is (group so far, next window of bytes, whether the text ends in it); rows
alone under their key are unique and leave, groups whose text has ended are
groups of equal texts and leave, the others go on with the bytes after the
window. Equality is decided on the bytes themselves: no digest is compared.

Windows grow by a factor (128 bytes, 4 KiB, 128 KiB, ...), so a text of L bytes
takes log(L) rounds and each byte of it is compared once. Group sizes come from
a map-side combined aggregate; the rows then meet only the keys held by more
than one row, in a left join where AQE splits a key held by a third of all
rows. Text leaves the rows as soon as it is decided. Rounds are written tables.

Defined cases: null text counts as empty, so null and empty texts form one
group; rows with a null id take part, ``keep_id`` is the smallest non-null id of
the group (null if there is none); ``kept`` holds for every row with that id, so
a row repeated with id and text is marked alike (``deduplicate`` returns it
once); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SPACES, rows_chosen, staged


def normalised(text_col: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ").cast("binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 first_window: int = 128, growth: int = 32) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept,
    text_sha256 of the normalised text (for the reader; never compared)."""
    rest = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("rest")).select(
        "id", F.sha2("rest", 256).alias("sha"), F.lit(0).cast("long").alias("grp"), "rest")
    window, decided = first_window, []
    while True:
        rows = rest.withColumn("digit", F.substring("rest", 1, window)) \
                   .withColumn("ended", F.length("rest") <= window)
        groups = staged(
            rows.groupBy("grp", "digit", "ended")
                .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep"))
                .where("n > 1").withColumn("next_grp", F.monotonically_increasing_id()),
            "radix-groups")
        on = rows.join(groups, ["grp", "digit", "ended"], "left")
        goes_on = F.col("n").isNotNull() & ~F.col("ended")
        out = staged(on.select(
            "id", "sha", goes_on.alias("open"),
            F.when(~goes_on & F.col("n").isNotNull(), F.col("keep"))
             .when(~goes_on, F.col("id")).alias("keep"),
            F.coalesce("n", F.lit(1).cast("long")).alias("n"),
            F.coalesce("next_grp", F.lit(0).cast("long")).alias("grp"),
            F.when(goes_on, F.substr(F.col("rest"), F.lit(window + 1),
                                     F.greatest(F.length("rest") - window, F.lit(0))))
             .alias("rest")), "radix-rows")
        decided.append(out.where("NOT open").select("id", "sha", "keep", "n"))
        if groups.where("NOT ended").isEmpty():
            break
        rest = out.where("open").select("id", "sha", "grp", "rest")
        window = min(window * growth, 1 << 30)      # substring takes 32-bit lengths
    return reduce(DataFrame.unionAll, decided).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns."""
    chosen = exact_groups(docs, id_col, text_col).where("kept") \
        .groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("key")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return rows_chosen(docs, chosen, F.sha2(normalised(text_col), 256), id_col)
