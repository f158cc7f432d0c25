"""Validation rules on hand-made raw CSV exports (edge rows from FIXTURES.md section 4)."""

from __future__ import annotations

import os

from arledger.operators import quality
from arledger.sources import erp

CUSTOMERS = """KUNNR,BUKRS,NAME1,LAND1,REGIO,BRSCH,KTOKD,ZTERM,KLIMK,ERDAT
C000001,1000,"Acme, Inc.",US,TX,EN,Z001,NT30,5000,2020-01-01
C000002,1000,Beta,US,XX,MF,Z001,NT30,abc,2020-01-01
C000003,1000,Gamma,US,NY,ZZ,Z001,NT99,0,
C000004,1000,,US,CA,RT,Z001,NT45,,2020-01-01
"""
INVOICES = """BELNR,BUKRS,GJAHR,BUZEI,KUNNR,BLART,BLDAT,BUDAT,FAEDT,AUGDT,DMBTR,WAERS,SHKZG,ZTERM
1800000001,1000,2022,001,C000001,DR,2022-01-10,2022-01-10,2022-02-09,2022-02-15,100.00,USD,S,NT30
1800000002,1000,2022,001,C000009,DR,2022-01-10,2022-01-10,2022-01-05,2022-01-01,200.00,USD,S,NT30
1800000003,1000,2022,001,C000001,DR,2022-01-10,2022-01-10,2022-02-09,,-5,EUR,H,NT30
"""
AGING = """KUNNR,BUKRS,STIDA,Current,1-30 days,31-60 days,61-90 days,91-180 days,180+ days,TOTAL_OUTSTANDING,WAERS
C000001,1000,2024-06-30,10,0,0,0,0,0,10,USD
C000002,1000,2024-06-30,10,-5,0,0,0,0,20,USD
"""
GL = """RBUKRS,RACCT,GJAHR,POPER,HSL,WAERS
1000,113100,2022,001,10.5,USD
1000,113100,2022,000,10.5,USD
1000,113100,2022,013,10.5,USD
1000,113100,2022,abc,10.5,USD
"""


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def _report(spark, tmp_dir, drop_gl=False):
    paths = {
        "customer_master": _write(tmp_dir, "c.csv", CUSTOMERS),
        "invoice_history": _write(tmp_dir, "i.csv", INVOICES),
        "ar_aging": _write(tmp_dir, "a.csv", AGING),
        "gl_cash_positions": os.path.join(tmp_dir, "missing.csv") if drop_gl else _write(tmp_dir, "g.csv", GL),
    }
    rep = quality.validate_all(erp.read_raw_tables(spark, paths))
    return {(r["dataset"], r["rule"], r["col_name"]): r for r in rep.collect()}


def test_rules(spark, tmp_dir):
    r = _report(spark, tmp_dir)
    assert r[("customer_master", "not_null", "NAME1")]["n_bad"] == 1
    assert r[("customer_master", "non_numeric", "KLIMK")]["n_bad"] == 1
    assert r[("customer_master", "numeric_range", "KLIMK")]["n_bad"] == 1  # 0 < 1000
    assert r[("customer_master", "valid_values", "BRSCH")]["detail"] == "ZZ"
    assert r[("customer_master", "valid_values", "ZTERM")]["detail"] == "NT99"
    assert r[("invoice_history", "referential_integrity", "KUNNR")]["n_bad"] == 1
    # FAEDT < BLDAT and AUGDT < BLDAT on the same row count twice
    assert r[("invoice_history", "date_consistency", "BLDAT,FAEDT,AUGDT")]["n_bad"] == 2
    assert r[("invoice_history", "valid_values", "WAERS")]["detail"] == "EUR"
    assert r[("invoice_history", "numeric_range", "DMBTR")]["n_bad"] == 1
    # total 20 vs bucket sum 5 (mismatch) + one negative cell
    assert r[("ar_aging", "aging_consistency", "TOTAL_OUTSTANDING")]["n_bad"] == 2
    assert r[("gl_cash_positions", "period_bounds", "POPER")]["n_bad"] == 3
    assert r[("customer_master", "valid_values", "BRSCH")]["n_rows"] == 4
    assert not r[("customer_master", "valid_values", "BRSCH")]["passed"]
    assert r[("gl_cash_positions", "not_null", "HSL")]["passed"]


def test_missing_file_and_columns(spark, tmp_dir):
    r = _report(spark, tmp_dir, drop_gl=True)
    assert r[("gl_cash_positions", "file_present", None)]["n_bad"] == 1
    df = spark.createDataFrame([("x",)], "KUNNR string")
    out = quality.validate_table("customer_master", df).collect()
    assert {row["col_name"] for row in out} == {"BUKRS", "NAME1", "LAND1", "REGIO", "BRSCH", "ZTERM", "KLIMK", "ERDAT"}


def test_class_balance(spark, tmp_dir):
    inv = erp.read_raw(spark, _write(tmp_dir, "i.csv", INVOICES), "invoice_history")
    row = quality.class_balance_report(inv).first()
    assert (row["n_cleared"], row["n_late"], row["n_on_time"]) == (2, 1, 1)
    assert not row["imbalance_warning"]


def test_every_invalid_value_is_found_with_one_scan(spark, monkeypatch):
    from pyspark.sql import functions as F

    wild = spark.range(5_000).select(*[
        (F.concat(F.lit("v"), F.col("id") % 3000) if c == "BRSCH" else F.lit("NT30") if c == "ZTERM" else F.lit("TX") if c == "REGIO" else F.lit("5000")).alias(c)
        for c in quality.RULES["customer_master"].required])
    report = {(r["rule"], r["col_name"]): r for r in quality.validate_table("customer_master", wild).collect()}
    row = report[("valid_values", "BRSCH")]
    assert row["n_bad"] == 3000 and row["detail"].endswith("(3000 values)") and row["n_rows"] == 5000
    assert report[("valid_values", "REGIO")]["n_bad"] == 0
    full = quality.invalid_values("customer_master", wild)
    assert full.count() == 3000 and full.agg(F.sum("n_rows")).first()[0] == 5000
    empty = quality.validate_table("customer_master", wild.limit(0)).collect()
    assert len(empty) == len(report) and all(r["n_bad"] == 0 and r["n_rows"] == 0 for r in empty)


def test_missing_file_is_not_any_fault(spark, tmp_dir):
    assert erp.read_raw_optional(spark, tmp_dir + "/none.csv", "customer_master") is None
    path = _write(tmp_dir, "c.csv", CUSTOMERS)
    assert erp.read_raw_optional(spark, path, "customer_master").count() == 4
    assert erp.path_exists(spark, tmp_dir + "/*.csv") and not erp.path_exists(spark, tmp_dir + "/*.txt")


def test_invalid_values_of_every_table(spark):
    from pyspark.sql import functions as F

    tables = {
        "customer_master": spark.createDataFrame([("C1", "ZZ", "XX", "Q9")], "KUNNR string, BRSCH string, REGIO string, ZTERM string"),
        "invoice_history": spark.createDataFrame([("H", "EUR", "Q9"), ("H", "USD", None)], "SHKZG string, WAERS string, ZTERM string"),
        "ar_aging": spark.createDataFrame([("GBP",)], "WAERS string"),
        "gl_cash_positions": spark.createDataFrame([("JPY",), ("USD",)], "WAERS string"),
    }
    empty = {c for rules in quality.RULES.values() for c in [*rules.required, "AUGDT"]}
    full = {}
    for name, df in tables.items():
        full[name] = df.select("*", *[F.lit(None).cast("string").alias(c) for c in sorted(empty - set(df.columns))])
    got = {tuple(r) for r in quality.all_invalid_values(full).collect()}
    assert got == {
        ("customer_master", "BRSCH", "ZZ", 1), ("customer_master", "REGIO", "XX", 1), ("customer_master", "ZTERM", "Q9", 1),
        ("invoice_history", "SHKZG", "H", 2), ("invoice_history", "WAERS", "EUR", 1), ("invoice_history", "ZTERM", "Q9", 1),
        ("ar_aging", "WAERS", "GBP", 1), ("gl_cash_positions", "WAERS", "JPY", 1)}
