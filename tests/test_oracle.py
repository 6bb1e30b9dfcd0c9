"""Every registered query against SQL on an independent engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import mailscope_oracle
from mailscope import catalog
from tests.comparison import connect, oracle_result, spark_result
from tests.conftest import SF_DIR

QUERIES = catalog.queries()
ORACLE = mailscope_oracle.statements()


@pytest.fixture(scope="module")
def engine():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, engine, name):
    df = QUERIES[name](spark, SF_DIR)
    assert spark_result(df) == oracle_result(engine, ORACLE[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["status_sender", "n", "mean", "median", "sd", "min", "q1", "q3", "max"]
    assert df.count() == 5
