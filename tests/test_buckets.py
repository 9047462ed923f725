"""The bucketed mapping store: merges without an exchange of the store."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tessera.sources.buckets import joined_in_buckets, load_bucketed, merged, save_bucketed, upsert_bucketed


def _rows(spark, sources, chunks, text):
    return spark.createDataFrame([(f"{s}:{i}", s, i, text) for s in sources for i in range(chunks)],
                                 "chunk_id string, source string, chunk_index int, text string")


def _held(spark, base):
    return {(r.chunk_id, r.text) for r in load_bucketed(spark, base).collect()}


@pytest.mark.parametrize("prune", [False, True])
def test_upsert_equals_a_dictionary(spark, scratch, prune):
    base = f"{scratch}/store"
    assert load_bucketed(spark, base).count() == 0
    upsert_bucketed(_rows(spark, [f"s{k}" for k in range(40)], 3, "one"), base, 8, prune)
    upsert_bucketed(_rows(spark, ["s3", "s7", "new"], 2, "two"), base, 8, prune)
    want = {f"s{k}:{i}": "one" for k in range(40) for i in range(3)}
    if prune:
        want = {k: v for k, v in want.items() if k.split(":")[0] not in ("s3", "s7")}
    want |= {f"{s}:{i}": "two" for s in ("s3", "s7", "new") for i in range(2)}
    assert _held(spark, base) == set(want.items())
    with pytest.raises(ValueError):
        upsert_bucketed(_rows(spark, ["x"], 1, "t"), base, 16)


@pytest.mark.parametrize("prune", [False, True])
def test_merge_has_no_exchange_of_the_store(spark, scratch, prune):
    base = f"{scratch}/store"
    save_bucketed(_rows(spark, [f"s{k}" for k in range(200)], 3, "one"), base, 8)
    new = _rows(spark, ["s3"], 2, "two")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_in_buckets(spark):
            plan = merged(load_bucketed(spark, base), new, prune)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    # every exchange is above the increment's rows, none above the store's scan
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    depth = [len(re.match(r"[ :+\-|]*", line)[0]) for line in lines]
    above, level = [], depth[scan]
    for i in range(scan - 1, -1, -1):
        if depth[i] < level:
            above.append(lines[i])
            level = depth[i]
    assert not [line for line in above if "Exchange" in line]


def test_a_killed_write_leaves_the_old_rows(spark, scratch):
    base = f"{scratch}/store"
    upsert_bucketed(_rows(spark, ["a"], 2, "one"), base, 4)
    os.makedirs(f"{base}/v000002")                       # no _SUCCESS
    assert len(_held(spark, base)) == 2
    path = upsert_bucketed(_rows(spark, ["b"], 1, "two"), base, 4)
    assert path.endswith("v000003") and len(_held(spark, base)) == 3
