"""The README's usage example, run on the sf0.001 tables."""

from conftest import SF001


def test_usage_example(spark, scratch):
    sf, store = SF001, f"{scratch}/mapping"
    # --- README example ---------------------------------------------------
    from pyspark.sql import functions as F
    import tessera as ts
    from tessera.operators.chunking import corpus_uri

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = docs.select(corpus_uri(F.col("source"), F.col("doc_id")).alias("uri"), "text")
    summary = ts.run_ingest(spark, texts, "gs://corpus/", store)        # build_and_upsert

    from tessera.sources.mapping import load_mapping
    chunks = load_mapping(spark, store)
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text")
    answers = ts.context(questions, ts.retrieve(questions, chunks, k=5))  # retrieve_documents

    index = ts.page_index(spark.read.parquet(f"{sf}/pages.parquet"))
    items, results = ts.web_search(questions, index, 3)                   # google_search
    pages = ts.fetch_pages(results, spark.read.parquet(f"{sf}/pages.parquet"))  # fetch_search_pages
    # ----------------------------------------------------------------------
    assert summary["chunks"] > 0 and answers.count() == questions.count()
    assert results.count() == questions.count() and pages.count() == questions.count()
