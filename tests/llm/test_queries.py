"""The registered queries against their SQL, over the whole small tables."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from arledger.llm import queries

DIR = "/root/testdata/sf0.001"
ORACLE = queries.ORACLE | corpus_pipeline.ORACLE
NUMBERED = {f"op{n}_" for n in range(1, 14)}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    found = (queries.QUERIES | corpus_pipeline.QUERIES)[name](spark, DIR)
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_each_operator_has_one_query():
    assert {n[: n.index("_") + 1] for n in queries.QUERIES} == NUMBERED and len(queries.QUERIES) == 13
    assert set(queries.QUERIES) - set(queries.ORACLE) == {"op5_language_fusion", "op7_packed_rows", "op8_prefix_token_counts", "op13_factorization_toxicity"}


PYTHON = ("MapInArrow", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups")


@pytest.mark.parametrize("name", ["op9_jump_shards", "op10_poisson_mix"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in PYTHON) and "CartesianProduct" not in plan and "NestedLoop" not in plan
