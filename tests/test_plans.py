"""Physical-plan checks: no Python UDFs, pruned scans, one shuffle of the fact rows for history."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from arledger.plans import registry
from tests.conftest import SF_SMALL

registry.load_all()
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_no_python_in_relational_plans(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert not any(n in plan for n in PY_NODES), name


def test_scan_is_pruned(spark):
    plan = _plan(registry.QUERIES["p2_kpis"](spark, SF_SMALL))
    assert plan.count("ReadSchema: struct<DMBTR:double,CUST_LATE_RATE:double,CUST_INVOICE_COUNT:int>") == plan.count("ReadSchema") == 1


def _static(df, spark) -> str:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_facts_are_reduced_before_segments_are_joined(spark):
    from arledger.plans.inputs import Inputs

    plan = _static(Inputs(spark, SF_SMALL).customer_months, spark)
    assert plan.count("orders.parquet") == 1 and plan.count("partial_sum") >= 1
    reduced = plan.index("HashAggregate")
    assert all(plan.index(j) < reduced for j in ("Join",))  # plans print top down: every join is above the aggregate


def test_scalar_rules_are_one_keyless_aggregate(spark):
    """The counters of a table come from one scan and one row per task; invalid values from the few columns with code
    lists, filtered before they are unfolded and grouped."""
    from arledger.operators import quality
    from arledger.plans.inputs import Inputs

    raw = Inputs(spark, SF_SMALL).customers_raw
    aggs, _ = quality.scalar_rules("customer_master", raw, quality.RULES["customer_master"])
    plan = _static(raw.agg(*aggs), spark)
    assert plan.count("customer.parquet") == 1 and "Exchange hashpartitioning" not in plan and "Generate" not in plan
    values = _static(quality.invalid_values("customer_master", raw), spark)
    assert values.count("customer.parquet") == 1 and values.count("Exchange hashpartitioning") == 1
    lines = values.splitlines()
    at = {word: next(i for i, line in enumerate(lines) if word in line) for word in ("Generate", "FileScan")}
    assert any("Filter" in line for line in lines[at["Generate"] : at["FileScan"]]) and "c_acctbal" not in values


def test_split_is_a_projection_of_one_scan(spark):
    from arledger.plans.inputs import Inputs

    plan = _static(Inputs(spark, SF_SMALL).split, spark)
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_history_shuffles_fact_rows_once(spark):
    from arledger.operators import features
    from arledger.plans.inputs import Inputs

    inp = Inputs(spark, SF_SMALL)
    cleared = inp.invoices.where("STATUS = 'CLEARED'")
    df = features.customer_history(cleared)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    # exactly one row-level window over (KUNNR, BLDAT) in ascending document order: the fact rows
    # are scanned, shuffled and sorted once (a second consumer would duplicate this subtree)
    level1 = [l for l in lines if "Window [row_number() windowspecdefinition(KUNNR" in l and " ASC " in l]
    assert len(level1) == 1
    # the day table's inputs are reduced before their shuffles: a partial aggregate and a partial
    # top-3 limit per customer-day
    assert any("WindowGroupLimit" in l and "Partial" in l for l in lines)
    assert any("HashAggregate(keys=[KUNNR" in l and "partial_count" in l for l in lines)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feature_store_stages_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes (HugeMethodLimit)."""
    from arledger.operators.features import build_feature_store
    from arledger.plans.inputs import Inputs

    inp = Inputs(spark, SF_SMALL)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for asof in (False, True):
            capsys.readouterr()
            build_feature_store(inp.customers, inp.invoices, inp.gl, asof=asof).explain("codegen")
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
