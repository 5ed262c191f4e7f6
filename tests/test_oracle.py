"""Every query with check SQL against DuckDB on the small tables."""

import pytest

import __spark_entry__ as entry_module
from compare import connect, mismatch

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["label", "flows", "mean_packet_rate"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    assert mismatch(df, con, ORACLE[name]) is None
    # whatever the data size, no row is paired with every row of another table
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
