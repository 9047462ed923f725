"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver's correctness gate runs the same at sf0.01)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

from conftest import SF001

# the training-data queries have their own tests in tests/llm
NAMES = sorted(set(E.queries()) - set(E.LLM_QUERIES))


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF001)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 40 and df.columns == ["query_id", "hits", "top_score", "context", "sources"]
