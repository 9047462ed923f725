from pyspark.sql import functions as F

from tessera.functions.embed import tokens
from tessera.functions.html import extract_urls, page_text
from tessera.functions.ids import namespace_hex, uuid5
from tessera.functions.sql import register_sql_functions
from tessera.functions.text import clean_text
from tessera.operators.chunking import chunk_pieces, chunk_windows

from conftest import SF001


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark)
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    d.createOrReplaceTempView("docs_t")
    ns = namespace_hex("gs://x/")
    got = spark.sql(f"""SELECT doc_id, tessera_clean_text(text) AS c, tessera_chunks(text, 1000, 100) AS ch,
                               tessera_chunks(text, 30, 45) AS ch2,
                               tessera_uuid5('{ns}', CAST(doc_id AS STRING)) AS u, tessera_tokens(text) AS tk
                        FROM docs_t""").collect()
    c = clean_text(F.col("text"))
    want = d.select("doc_id", c.alias("c"),
                    chunk_windows(chunk_pieces(c, 1000, 100), F.length(c), 1000, 100).alias("ch"),
                    chunk_windows(chunk_pieces(c, 30, 45), F.length(c), 30, 45).alias("ch2"),
                    uuid5(ns, F.col("doc_id").cast("string")).alias("u"),
                    tokens(F.col("text")).alias("tk")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    p = spark.read.parquet(f"{SF001}/pages.parquet")
    p.createOrReplaceTempView("pages_t")
    got = spark.sql("SELECT page_id, tessera_page_text(html) AS t, "
                    "tessera_extract_urls(concat(url, ' ', url, ').'), 3) AS u FROM pages_t").collect()
    want = p.select("page_id", page_text(F.col("html")).alias("t"),
                    extract_urls(F.concat("url", F.lit(" "), "url", F.lit(").")), 3).alias("u")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
