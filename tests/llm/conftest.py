import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

# Cases every operator on documents must take: nulls, empty and blank texts,
# ties, repeated rows, one very long text, and columns whose names clash.
LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, None), (None, "a lone text without an id"),
       (4, "tie text here"), (4, "tie text here"), (5, "tie  text\there"), (6, LONG),
       (7, LONG + "x"), (8, "Ünïcödé 中文 🙂 text"), (9, "word")]
CLASHING = ("id string, text_sha256 string, score double, node binary, n int, label string, "
            "k int, part int, n_chars long, lang string, source string")


def odd_docs(spark, rows=ODD):
    """(doc_id, text) rows with clashing extra columns."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for f in StructType.fromDDL(CLASHING):
        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.withColumn("source", F.when(F.col("doc_id") > 4, "web"))
