import pytest
from pyspark.sql import functions as F

from tessera.operators.upsert import merge, upsert_batches
from tessera.sources.mapping import MAPPING_SCHEMA, load_mapping, save_mapping, versions

OLD = [("a", "s1", 0, "old a"), ("b", "s1", 1, "old b"), ("c", "s2", 0, "old c")]
NEW = [("a", "s1", 0, "new a")]   # s1 shrank to one chunk


def _df(spark, rows):
    return spark.createDataFrame(rows, MAPPING_SCHEMA)


def _set(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_keeps_stale_and_replaces(spark):
    m = merge(_df(spark, OLD), _df(spark, NEW))
    assert _set(m) == [("a", "s1", 0, "new a"), ("b", "s1", 1, "old b"), ("c", "s2", 0, "old c")]


def test_merge_prune_stale(spark):
    m = merge(_df(spark, OLD), _df(spark, NEW), prune_stale=True)
    assert _set(m) == [("a", "s1", 0, "new a"), ("c", "s2", 0, "old c")]


def test_merge_idempotent_and_empty_old(spark):
    once = merge(_df(spark, OLD), _df(spark, NEW))
    assert _set(merge(once, _df(spark, NEW))) == _set(once)
    assert _set(merge(_df(spark, []), _df(spark, NEW))) == _set(_df(spark, NEW))


def test_mapping_store_versions(spark, scratch):
    store = f"{scratch}/mapping"
    assert load_mapping(spark, store).count() == 0          # absent path -> empty
    p1 = save_mapping(_df(spark, OLD), store)
    merged = merge(load_mapping(spark, store), _df(spark, NEW))
    p2 = save_mapping(merged, store)                         # read-then-write: new version
    assert versions(spark, store) == ["v000001", "v000002"] and p1 != p2
    assert _set(load_mapping(spark, store)) == _set(merged)


def test_mapping_store_corrupt_raises(spark, scratch):
    store = f"{scratch}/mapping"
    import os
    os.makedirs(f"{store}/v000001")
    open(f"{store}/v000001/part-0.parquet", "wb").write(b"not parquet")
    open(f"{store}/v000001/_SUCCESS", "wb").close()
    with pytest.raises(Exception):
        load_mapping(spark, store).collect()


def test_upsert_batches_slices(spark, scratch):
    import json, os
    out = f"{scratch}/sent"
    os.makedirs(out)
    df = spark.range(0, 250).repartition(2)

    def send(rows, out=out):
        import uuid
        with open(f"{out}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump([r.id for r in rows], f)

    upsert_batches(df, send, batch=100)
    batches = [json.load(open(f"{out}/{n}")) for n in os.listdir(out)]
    assert sorted(x for b in batches for x in b) == list(range(250))
    assert all(len(b) <= 100 for b in batches)


def test_export_json_lines(spark, scratch):
    from tessera.sources.mapping import export_mapping_json
    df = _df(spark, [("x", "gs://b/ü.txt", 0, "naïve text")])
    export_mapping_json(df, f"{scratch}/json")
    import glob, json
    lines = [json.loads(l) for f in glob.glob(f"{scratch}/json/*.json") for l in open(f, encoding="utf-8")]
    assert lines == [{"chunk_id": "x", "source": "gs://b/ü.txt", "chunk_index": 0, "text": "naïve text"}]
    raw = "".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{scratch}/json/*.json"))
    assert "naïve" in raw          # non-ASCII kept, not escaped


def test_partitioned_store_rewrites_only_touched(spark, scratch):
    import glob, os
    from tessera.sources.mapping import load_partitioned, upsert_partitioned
    base = f"{scratch}/pmap"
    old = [(f"id{i}", f"gs://b/f{i % 20}.txt", i // 20, f"old {i}") for i in range(200)]
    upsert_partitioned(_df(spark, old), base, n_parts=16)
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{base}/part=*/*.parquet")}
    new = [(f"id{i}", "gs://b/f3.txt", i // 20, f"new {i}") for i in range(3, 200, 20)][:5]
    touched = upsert_partitioned(_df(spark, new), base, n_parts=16)
    assert len(touched) == 1
    want = merge(_df(spark, old), _df(spark, new))
    assert _set(load_partitioned(spark, base)) == _set(want)
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{base}/part=*/*.parquet")}
    untouched = [p for p in before if f"part={touched[0]}/" not in p]
    assert untouched and all(p in after and after[p] == before[p] for p in untouched)
