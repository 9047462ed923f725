"""Plan properties the README claims, checked on the physical plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the training-data queries have their own tests in tests/llm
@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.LLM_QUERIES)))
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert not [k for k in FORBIDDEN if k in plan]


def test_prefix_listing_pushes_down(spark, scratch):
    from tessera.operators.catalog import list_objects
    rows = [("bk", f"a/{i}.txt", i, "text/plain", dt.datetime(2024, 1, 1)) for i in range(50)]
    spark.createDataFrame(rows, "bucket string, name string, size long, content_type string, "
                                "updated timestamp").write.parquet(f"{scratch}/objects")
    objects = spark.read.parquet(f"{scratch}/objects")
    entries, _ = list_objects(objects, "bk", "a/1", None, 10)
    plan = _plan(entries)
    assert "StringStartsWith(name,a/1)" in plan and "TakeOrderedAndProject" in plan


def test_topk_plans_limit_before_shuffle(spark):
    plan = _plan(E.queries()["retrieve_hits"](spark, SF001))
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan
    # one shuffle of either side onto the grid, and no broadcast of queries
    assert plan.count("hashpartitioning(cell") == 2 and "SortMergeJoin" in plan
