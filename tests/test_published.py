"""Published model versions, quarantined records, rules measured on load, the session's shared folder."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from arledger import session
from arledger.operators import quality
from arledger.plans.inputs import Inputs
from arledger.sources import erp, models

SMALL = "/root/testdata/sf0.001"
HEADER = "KUNNR,BUKRS,NAME1,LAND1,REGIO,BRSCH,KTOKD,ZTERM,KLIMK,ERDAT\n"
GOOD = 'C000001,1000,"Acme, Inc.",US,TX,EN,Z001,NT30,5000,2020-01-01\n'
TWO_LINES = 'C000002,1000,"Beta\nHoldings",US,TX,EN,Z001,NT30,5000,2020-01-01\n'
SHORT, LONG, OPEN = "C000003,1000,Gamma\n", GOOD.strip() + ",more,fields\n", 'C000004,1000,"Delta,US,TX,EN,Z001,NT30,5000,2020-01-01\n'
GL = "RBUKRS,RACCT,GJAHR,POPER,HSL,WAERS\n1000,113100,2022,001,10.5,USD\n1000,113100\n"
INVOICES = """BELNR,BUKRS,GJAHR,BUZEI,KUNNR,BLART,BLDAT,BUDAT,FAEDT,AUGDT,DMBTR,WAERS,SHKZG,ZTERM
1800000001,1000,2022,001,C000001,DR,2022-01-10,2022-01-10,2022-02-09,2022-02-15,100.00,USD,S,NT30
"""


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_newest_complete_version_is_found(spark, tmp_dir):
    assert models.latest(spark, f"{tmp_dir}/none") is None
    codes = spark.createDataFrame([("REGION", "ASIA", 3)], "column string, label string, code int")
    for v in ("b", "a", "c"):
        models.save_codes(codes.withColumn("code", F.lit(ord(v))), f"{tmp_dir}/m/{v}")
        models.publish(spark, f"{tmp_dir}/m/{v}", {"kind": "codes"})
    models.save_codes(codes, f"{tmp_dir}/m/d")  # a job that died before its manifest
    os.makedirs(f"{tmp_dir}/m/e/manifest")
    path, entries = models.latest(spark, f"{tmp_dir}/m")
    assert path.endswith("/c") and entries["kind"] == "codes" and models.load_codes(spark, path).first()["code"] == ord("c")
    assert len(models.versions(spark, f"{tmp_dir}/m")) == 3


def test_published_model_scores_with_its_own_codes(spark):
    from arledger.operators.classify import TrainedClassifier, score_invoices

    inp = Inputs(spark, SMALL)
    own = inp.model_scored.select("BELNR", "LATE_PROB")
    model, codes = TrainedClassifier.load_published(session.models_dir(spark, "classifier", SMALL))
    assert model.threshold == inp.classifier.threshold and model.trace == inp.classifier.trace
    again = score_invoices(model, codes, inp.customers, inp.invoices, inp.gl)
    assert again.join(own.withColumnRenamed("LATE_PROB", "p"), "BELNR").where("abs(LATE_PROB - p) > 1e-9").count() == 0
    # new invoices of one region only: their codes are those of the training data, not 0
    region = inp.customers.where("REGION is not null").select("REGION").distinct().orderBy(F.desc("REGION")).first()[0]
    few = score_invoices(model, codes, inp.customers.where(F.col("REGION") == region), inp.invoices, inp.gl)
    want = codes.where((F.col("column") == "REGION") & (F.col("label") == region)).first()["code"]
    found = {r[0] for r in few.where(F.col("REGION") == region).select("REGION_CODE").distinct().collect()}
    assert found == {want} and want > 0
    with pytest.raises(FileNotFoundError):
        TrainedClassifier.load_published("/tmp/no-such-folder-of-models")


def test_malformed_records_are_kept_apart(spark, tmp_dir):
    path = _write(tmp_dir, "c.csv", HEADER + GOOD + SHORT + GOOD + LONG)
    good, bad = erp.read_quarantined(spark, path, "customer_master")
    assert good.count() == 2 and "_MALFORMED" not in good.columns
    assert {r["record"] for r in bad.collect()} == {SHORT.strip(), LONG.strip()}
    lines = _write(tmp_dir, "two.csv", HEADER + GOOD + TWO_LINES)
    good, bad = erp.read_quarantined(spark, lines, "customer_master")
    assert good.count() == 1 and bad.count() == 2  # both halves of the record
    good, bad = erp.read_quarantined(spark, lines, "customer_master", multi_line=True)
    assert bad.count() == 0 and [r["NAME1"] for r in good.orderBy("KUNNR").collect()] == ["Acme, Inc.", "Beta\nHoldings"]
    opened = _write(tmp_dir, "open.csv", HEADER + GOOD + OPEN + GOOD)
    good, bad = erp.read_quarantined(spark, opened, "customer_master")
    assert good.count() == 2 and bad.count() == 1


def test_readers_pass_multi_line_and_report_malformed_records(spark, tmp_dir):
    c = _write(tmp_dir, "c.csv", HEADER + GOOD + TWO_LINES + SHORT)
    i, g = _write(tmp_dir, "i.csv", INVOICES), _write(tmp_dir, "g.csv", GL)
    customers, invoices, gl = erp.load_raw_data(spark, c, i, g, multi_line=True, quarantine_path=f"{tmp_dir}/bad")
    assert (customers.count(), invoices.count(), gl.count()) == (2, 1, 1)
    assert sorted((r["dataset"], r["record"]) for r in spark.read.parquet(f"{tmp_dir}/bad").collect()) == [("customer_master", SHORT.strip()), ("gl_cash_positions", "1000,113100")]
    assert erp.load_raw_data(spark, c, i, g)[0].count() == 1
    tables = erp.read_raw_tables(spark, {"customer_master": c, "invoice_history": i, "gl_cash_positions": g, "ar_aging": f"{tmp_dir}/none.csv"})
    report = {(r["dataset"], r["rule"]): r for r in quality.validate_all(tables).collect()}
    assert report[("customer_master", "malformed_records")]["n_bad"] == 3 and not report[("customer_master", "malformed_records")]["passed"]
    assert report[("invoice_history", "malformed_records")]["passed"] and report[("ar_aging", "file_present")]["n_bad"] == 1
    assert quality.validate_table("customer_master", erp.read_raw_optional(spark, c, "customer_master", multi_line=True, malformed=True)).where(
        "rule = 'malformed_records'").first()["n_bad"] == 1


def test_rules_are_measured_by_the_write(spark, tmp_dir):
    """The same report as from scans; a clean table is read by the write only."""
    inp = Inputs(spark, SMALL)
    tables = {"customer_master": inp.customers_raw, "invoice_history": inp.invoices_raw, "ar_aging": inp.aging, "gl_cash_positions": inp.gl_raw}
    loaded, report = quality.load_validated(tables, f"{tmp_dir}/loaded")
    order = ["dataset", "rule", "col_name", "n_bad", "n_rows", "detail", "passed"]
    plain = quality.validate_all(tables)
    assert sorted(map(repr, report.select(order).collect())) == sorted(map(repr, plain.select(order).collect()))
    assert {k: v.count() for k, v in loaded.items()} == {k: v.count() for k, v in tables.items()}
    group = "rules-of-a-clean-table"
    measured, rules = quality.observed("gl_cash_positions", inp.gl_raw)
    measured.write.parquet(f"{tmp_dir}/gl")
    spark.sparkContext.setJobGroup(group, "")
    rules()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(None, None)
    assert jobs == 0
    missing, of = quality.observed("customer_master", inp.customers_raw.drop("ERDAT"))
    assert [r["col_name"] for r in of().collect()] == ["ERDAT"]


def test_report_plans_run_no_job(spark):
    inp = Inputs(spark, SMALL)
    spark.sparkContext.setJobGroup("plan-of-rules", "")
    quality.validate_all({"customer_master": inp.customers_raw, "invoice_history": inp.invoices_raw, "ar_aging": inp.aging, "gl_cash_positions": inp.gl_raw})
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-of-rules"))
    spark.sparkContext.setJobGroup(None, None)
    assert jobs == 0


class _Context:
    def __init__(self, master):
        self.master, self.applicationId, self.dir = master, f"app-{master}", None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master, path=None):
        self.sparkContext, self.path, self.conf = _Context(master), path, self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.path or default

    def set(self, *_):
        raise RuntimeError("CANNOT_MODIFY_CONFIG")


def test_shared_folder_with_and_without_the_setting():
    own = _Session("local[2]")
    path = session.checkpoint_dir(own)
    assert path == session.checkpoint_dir(own) == own.sparkContext.dir and os.path.isdir(path)
    given = _Session("spark://x", "hdfs://shared")
    assert session.checkpoint_dir(given) == "hdfs://shared" == given.sparkContext.dir
    for master in ("spark://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.checkpoint_dir(_Session(master))
