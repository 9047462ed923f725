from pyspark.sql import functions as F

from tessera.operators.catalog import list_objects, split_uri, stage_attachments

OBJ = [("bk", "a/b/c.txt", 10), ("bk", "a/d.txt", 20), ("bk", "e.txt", 30), ("bk", "ab.txt", 5)]


def _objs(spark):
    return spark.createDataFrame(OBJ, "bucket string, name string, size long").withColumn(
        "content_type", F.lit("text/plain")).withColumn("updated", F.lit(None).cast("timestamp"))


def test_listing_delimiter_and_prefix(spark):
    o = _objs(spark)
    e, s = list_objects(o, "bk", None, "/", 100)
    assert [(r.kind, r.name) for r in e.collect()] == [("folder", "a/"), ("file", "ab.txt"), ("file", "e.txt")]
    assert s.first().message == "Found 2 file(s) and 1 folder(s) in bucket 'bk'"
    e, s = list_objects(o, "bk", "a/", "/", 100)
    assert [(r.kind, r.name) for r in e.collect()] == [("folder", "a/b/"), ("file", "a/d.txt")]
    e, _ = list_objects(o, "bk", "a", "/", 100)
    assert [r.name for r in e.collect()] == ["a/", "ab.txt"]
    e, s = list_objects(o, "bk", "a", None, 100)
    assert [r.name for r in e.collect()] == ["a/b/c.txt", "a/d.txt", "ab.txt"]
    assert s.first().message.endswith("with prefix 'a'")
    e, _ = list_objects(o, "bk", None, None, 2)
    assert [r.name for r in e.collect()] == ["a/b/c.txt", "a/d.txt"]


def test_split_uri(spark):
    df = spark.createDataFrame([("gs://b/x/y",), ("gs://b",), ("gs://b/",)], "u string")
    b, p = split_uri(F.col("u"))
    assert [tuple(r) for r in df.select(b, p).collect()] == [("b", "x/y"), ("b", ""), ("b", "")]
    import pytest
    bad = spark.createDataFrame([("s3://b/x",)], "u string")
    with pytest.raises(Exception):
        bad.select(split_uri(F.col("u"))[0]).collect()


def test_stage_attachments(spark):
    parts_t = "array<struct<text:string,mime_type:string,data:binary>>"
    rows = [
        ("m1", "doc", None, None, [(None, "image/png", b"img"), (None, "application/pdf", b"%PDF")]),
        ("m2", "rep.PDF", None, None, [(None, "application/pdf", b"AA"), (None, "application/pdf", b"BBB")]),
        ("m3", "x", None, None, [(None, "application/pdf", b""), (None, "application/pdf", b"full")]),
        ("m4", "y", None, None, [("hello", "text/plain", None)]),
        ("m5", "z", "given/name", "application/zip", [(None, "application/zip", b"zz")]),
    ]
    df = spark.createDataFrame(rows, f"message_id string, artifact_name string, destination string, "
                                     f"content_type string, parts {parts_t}")
    got = {r.message_id: r for r in stage_attachments(df, "bk").collect()}
    assert (got["m1"].status, got["m1"].filename, got["m1"].size_bytes) == ("success", "DEV/doc.pdf", 4)
    assert got["m2"].filename == "DEV/rep.PDF" and got["m2"].size_bytes == 2
    assert got["m3"].status == "error" and got["m4"].status == "error"
    assert got["m5"].filename == "given/name" and got["m5"].gcs_uri == "gs://bk/given/name"
