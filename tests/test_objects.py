"""Text objects stay small, and their pages are handed on in bounded frames."""

from tessera.plans import q_stores
from tessera.sources import files as S


def test_objects_hold_a_bounded_number_of_rows(spark, scratch):
    spark.range(600).selectExpr("id AS doc_id", "concat('t', id) AS text").coalesce(1).write.parquet(
        f"{scratch}/documents.parquet")
    root = q_stores._written(spark, scratch, q_stores.PAGE_BREAK)
    sizes = [bytes(r.content).count(q_stores.PAGE_BREAK.encode())
             for r in S.read_corpus(spark, root, (".txt",)).collect()]
    assert sum(sizes) == 600 and max(sizes) <= q_stores.OBJECT_ROWS
    assert {tuple(r) for r in q_stores.q_paged_objects(spark, scratch).collect()} == \
        {(i, f"t{i}") for i in range(600)}


def test_pages_of_any_objects(spark, monkeypatch):
    files = spark.createDataFrame([("a", b"x|y"), ("b", b""), ("c", b"!")], "uri string, content binary")

    def pages(data):
        if data == b"!":
            raise ValueError
        return [None if p == "y" else p for p in data.decode().split("|")] if data else []
    got = {tuple(r) for r in S.extract_pages(files, pages).collect()}
    assert got == {("a", 0, "x"), ("a", 1, ""), ("c", 0, "")}
