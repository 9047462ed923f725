"""Plans of the ``opN_*`` queries: no products of tables, no row-at-a-time Python."""

import pytest

from tessera.llm import queries

SF001 = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_product_or_row_udf(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF001))
    assert not [k for k in FORBIDDEN if k in plan]
    if name.startswith("op4_"):                      # native: no Python at all
        assert not [k for k in ("Python", "MapInArrow", "MapInPandas", "Arrow") if k in plan]


def test_alignment_joins_postings_by_pair_and_gathers_them_by_block(spark):
    plan = plan_of(queries.QUERIES["op11_align"](spark, SF001))
    assert "FlatMapGroupsInArrow" in plan and "hashpartitioning(block" in plan


def test_encoding_has_no_shuffle(spark):
    assert "Exchange" not in plan_of(queries.QUERIES["op12_bpe"](spark, SF001))
