"""Incremental ingest by manifest, and stores that survive a cut write."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources.manifest import changes, load_manifest
from tessera.sources.mapping import (load_datapoints, load_mapping, load_partitioned, save_datapoints,
                                     upsert_partitioned)
from tessera.streaming.ingest import start_sync_stream, sync_corpus


def _write(root, name, text, at):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (at, at))
    return path


def _texts(spark, store):
    return {os.path.basename(r.source): r.text for r in load_mapping(spark, store).collect()}


def test_new_changed_touched_and_deleted_objects(spark, scratch):
    root, store, man, dps = (f"{scratch}/{n}" for n in ("in", "map", "manifest", "dps"))
    long = " ".join(f"sentence number {k}." for k in range(200))          # several chunks
    _write(root, "a.txt", "first text", 1000)
    _write(root, "deep/b.txt", long, 1000)
    _write(root, "c[1],{x}.txt", "odd name", 1000)
    _write(root, "skip.csv", "no", 1000)
    got = sync_corpus(spark, root, "docs/", store, man, dps)
    assert got == {"new": 3, "changed": 0, "deleted": 0}
    n_long = load_mapping(spark, store).where(F.col("source").endswith("b.txt")).count()
    assert n_long > 1 and load_datapoints(spark, dps).count() == n_long + 2
    assert sync_corpus(spark, root, "docs/", store, man, dps) == {"new": 0, "changed": 0, "deleted": 0}

    _write(root, "a.txt", "third text", 500)             # same length, an older time
    _write(root, "deep/b.txt", "short now", 2000)
    _write(root, "c[1],{x}.txt", "odd name", 3000)       # touched only
    _write(root, "d.txt", "a new one", 2000)
    assert sync_corpus(spark, root, "docs/", store, man, dps) == {"new": 1, "changed": 2, "deleted": 0}
    want = {"a.txt": "third text", "b.txt": "short now", "c[1],{x}.txt": "odd name", "d.txt": "a new one"}
    assert _texts(spark, store) == want
    contents = {r[0] for r in load_datapoints(spark, dps).select(
        F.col("restricts")[0]["allow_list"][0]).collect()}
    assert contents == set(want.values())

    os.remove(os.path.join(root, "a.txt"))
    assert sync_corpus(spark, root, "docs/", store, man, dps) == {"new": 0, "changed": 0, "deleted": 1}
    assert set(_texts(spark, store)) == set(want) - {"a.txt"}
    assert load_datapoints(spark, dps).count() == 3 and load_manifest(spark, man).count() == 3


def test_a_failed_step_is_repeated(spark, scratch, monkeypatch):
    import tessera.streaming.ingest as ingest
    root, store, man = (f"{scratch}/{n}" for n in ("in", "map", "manifest"))
    _write(root, "a.txt", "one", 1000)

    def broken(*a):
        raise OSError("cut")
    with monkeypatch.context() as m:
        m.setattr(ingest, "save_manifest", broken)
        with pytest.raises(OSError):
            sync_corpus(spark, root, "p/", store, man)
    assert sync_corpus(spark, root, "p/", store, man)["new"] == 1
    assert _texts(spark, store) == {"a.txt": "one"} and load_mapping(spark, store).count() == 1


def test_sync_as_a_stream(spark, scratch):
    root, store, man = (f"{scratch}/{n}" for n in ("in", "map", "manifest"))
    _write(root, "a.txt", "one", 1000)
    q = start_sync_stream(spark, root, "p/", store, man, f"{scratch}/ck", every="1 second")
    try:
        for text, at in (("one", 1000), ("two!", 2000)):
            _write(root, "a.txt", text, at)
            end = time.time() + 60
            while _texts(spark, store) != {"a.txt": text}:
                assert time.time() < end and q.exception() is None
                time.sleep(0.5)
    finally:
        q.stop()


def test_changes_with_known_digests(spark):
    import datetime as dt
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    schema = "uri string, length long, modified timestamp, digest string"
    old = spark.createDataFrame([("a", 1, t[0], "x"), ("b", 1, t[0], "x"), ("c", 1, t[0], "x"),
                                 ("d", 1, t[0], None)], schema)
    new = spark.createDataFrame([("a", 1, t[0], "x"), ("b", 1, t[1], "x"), ("c", 1, t[1], "y"),
                                 ("e", 2, t[1], "z")], schema)
    got = {r.uri: r.status for r in changes(old, new).collect()}
    assert got == {"a": "same", "b": "same", "c": "changed", "d": "deleted", "e": "new"}
    got = {r.uri: r.status for r in changes(old, new.drop("digest")).collect()}
    assert got["b"] == got["c"] == "candidate"


def _rows(spark, ids, v):
    return spark.createDataFrame([(i, v) for i in ids], "datapoint_id string, v int")


def test_a_cut_swap_leaves_rows_readable(spark, scratch):
    path = f"{scratch}/dp"
    save_datapoints(_rows(spark, "abc", 1), path)
    save_datapoints(_rows(spark, "c", 2), path)
    assert {tuple(r) for r in load_datapoints(spark, path).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    os.makedirs(f"{scratch}/_dp.next")                    # a write cut short
    assert load_datapoints(spark, path).count() == 3
    os.rename(path, f"{scratch}/_dp.old")                 # between the renames
    assert load_datapoints(spark, path).count() == 3
    save_datapoints(_rows(spark, "d", 3), path)
    assert load_datapoints(spark, path).count() == 4 and not os.path.exists(f"{scratch}/_dp.old")


def test_number_of_partitions_is_kept(spark, scratch):
    base = f"{scratch}/parts"
    rows = spark.range(1250).select(F.col("id").cast("string").alias("chunk_id"),
                                    F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("source"),
                                    F.lit(0).alias("chunk_index"), F.lit("t").alias("text"))
    upsert_partitioned(rows, base, 64)
    with pytest.raises(ValueError):
        upsert_partitioned(rows, base, 16)
    os.remove(f"{base}/_n_parts.64")                       # a store of an older release
    with pytest.raises(ValueError):
        upsert_partitioned(rows, base, 16)
    upsert_partitioned(rows.where("source = 's1'"), base, 64)
    assert load_partitioned(spark, base).count() == 1250
