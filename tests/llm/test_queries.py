"""Registered queries against their SQL, and the pipeline end to end."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from mailscope.llm import queries
from tests.comparison import connect, oracle_result, spark_result
from tests.conftest import SF_DIR


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert spark_result(queries.QUERIES[name](spark, SF_DIR)) == oracle_result(connect(SF_DIR), queries.ORACLE[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3]
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_stages_take_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
