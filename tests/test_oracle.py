"""Every query with an oracle SQL text must match DuckDB (rows, names, values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from arledger.plans import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

registry.load_all()
ORACLE = registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    sdf = registry.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLE[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    exact, info, close = compare(rows, sdf.columns, drows, dcols)
    assert close, f"{name}: {info}"


def test_every_query_has_docs_and_unique_names():
    qs = entry.queries()
    assert len(qs) >= 80
    assert set(ORACLE) <= set(qs)
    for name, fn in qs.items():
        assert fn.__doc__, name


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns
    assert df.count() >= 0
