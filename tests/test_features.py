"""Feature store: hand-made edge rows and the two-level history against a single window."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arledger.constants import FEATURE_STORE_COLS
from arledger.operators import features, normalize

D = dt.date

INV_SCHEMA = T.StructType([
    T.StructField("BELNR", T.StringType()), T.StructField("BUZEI", T.StringType()),
    T.StructField("KUNNR", T.StringType()), T.StructField("BLDAT", T.DateType()),
    T.StructField("FAEDT", T.DateType()), T.StructField("AUGDT", T.DateType()),
    T.StructField("DMBTR", T.StringType()), T.StructField("ZTERM", T.StringType()),
])


def _inv(spark, rows):
    return normalize.invoice_history(spark.createDataFrame(rows, INV_SCHEMA))


def test_late_flag_when_due_date_missing(spark):
    df = _inv(spark, [("1", "001", "C1", D(2022, 1, 1), None, D(2022, 2, 1), "10", "NT30"),
                      ("2", "001", "C1", D(2022, 1, 1), D(2022, 1, 31), None, "10", "NT30")])
    got = {r["BELNR"]: r for r in df.collect()}
    assert got["1"]["STATUS"] == "CLEARED" and got["1"]["DAYS_LATE"] is None and got["1"]["LATE_FLAG"] == 0.0
    assert got["2"]["STATUS"] == "OPEN" and got["2"]["LATE_FLAG"] is None


def test_history_first_invoice_ties_and_rolling(spark):
    rows = [
        ("1", "001", "C1", D(2022, 1, 1), D(2022, 1, 31), D(2022, 2, 10), "100", "NT30"),   # 10 late
        ("2", "001", "C1", D(2022, 1, 5), D(2022, 2, 4), D(2022, 2, 1), "300", "NT30"),     # -3
        ("3", "001", "C1", D(2022, 1, 5), D(2022, 2, 4), D(2022, 2, 6), "200", "NT30"),     # 2, same date
        ("4", "001", "C1", D(2022, 2, 1), D(2022, 3, 3), D(2022, 3, 10), "abc", "NT30"),    # amount not numeric
        ("5", "001", "C1", D(2022, 3, 1), D(2022, 3, 31), D(2022, 4, 5), "50", "NT30"),
    ]
    cleared = _inv(spark, rows).where("STATUS = 'CLEARED'")
    out = {r["BELNR"]: r for r in features.customer_history(cleared).collect()}
    first = out["1"]
    assert first["CUST_INVOICE_COUNT"] == 0 and first["CUST_AVG_DAYS_LATE"] == 0.0
    assert first["CUST_AVG_AMOUNT"] == 100.0 and first["CUST_TOTAL_EXPOSURE"] == 0.0
    assert first["CUST_AMOUNT_CONCENTRATION"] == 1.0 and first["CUST_MAX_INVOICE"] == 0.0
    # same-date rows: BELNR breaks the tie, so 3 sees 1 and 2
    assert out["3"]["CUST_INVOICE_COUNT"] == 2
    assert abs(out["3"]["CUST_AVG_DAYS_LATE"] - 3.5) < 1e-12
    assert out["3"]["CUST_MAX_INVOICE"] == 300.0
    # row 5: previous three rows are 2, 3, 4 (days -3, 2, 7)
    assert abs(out["5"]["CUST_ROLLING3_DAYS_LATE"] - 2.0) < 1e-12
    assert abs(out["5"]["CUST_LATE_RATE"] - 0.75) < 1e-12
    # non-numeric amount: ignored by the prior mean and sum, no own amount fallback needed
    assert abs(out["5"]["CUST_AVG_AMOUNT"] - 200.0) < 1e-12
    assert out["4"]["DMBTR"] is None and abs(out["4"]["CUST_AVG_AMOUNT"] - 200.0) < 1e-12


def test_two_level_history_equals_single_window_on_skewed_data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        cust = "HOT" if rnd.random() < 0.4 else f"C{rnd.randint(1, 40)}"
        day = D(2021, 1, 1) + dt.timedelta(days=rnd.randint(0, 60))
        due = day + dt.timedelta(days=30) if rnd.random() > 0.02 else None
        aug = day + dt.timedelta(days=rnd.randint(0, 60))
        amt = str(round(rnd.uniform(10, 1000), 2)) if rnd.random() > 0.02 else None
        rows.append((f"{i:06d}", "001", cust, day, due, aug, amt, "NT30"))
    cleared = _inv(spark, rows)
    a = features.customer_history(cleared)
    b = features.customer_history_single_window(cleared)
    cols = ["CUST_AVG_DAYS_LATE", "CUST_LATE_RATE", "CUST_INVOICE_COUNT", "CUST_AVG_AMOUNT", "CUST_TOTAL_EXPOSURE",
            "CUST_ROLLING3_DAYS_LATE", "CUST_MAX_INVOICE", "CUST_LATE_TREND", "CUST_AMOUNT_CONCENTRATION"]
    j = a.select("BELNR", *[F.col(c).alias("a_" + c) for c in cols]).join(
        b.select("BELNR", *[F.col(c).alias("b_" + c) for c in cols]), "BELNR")
    diffs = j.select(*[F.max(F.abs(F.col("a_" + c) - F.col("b_" + c))).alias(c) for c in cols]).first()
    assert j.count() == 3000
    for c in cols:
        assert diffs[c] is None or diffs[c] < 1e-6, c


def test_feature_store_edge_rows(spark):
    inv = _inv(spark, [
        ("1", "001", "C1", D(2022, 3, 28), D(2022, 4, 27), D(2022, 5, 1), "100", "NT30"),
        ("2", "001", "C1", D(2022, 3, 29), D(2022, 4, 28), D(2022, 4, 20), "100", "NTXX"),  # unknown terms: dropped
        ("3", "001", "C9", D(2022, 3, 29), D(2022, 4, 28), D(2022, 4, 20), "100", "NT30"),  # not in master: codes -1
    ])
    cust = spark.createDataFrame([("C1", "NT30", 0.0, "Retail", "South")],
                                 "KUNNR string, ZTERM string, KLIMK double, INDUSTRY string, REGION string")
    gl = spark.createDataFrame([("202203", 5.0)], "FISCPER string, HSL double")
    fs = features.build_feature_store(cust, inv, gl)
    got = {r["BELNR"]: r for r in fs.collect()}
    assert fs.columns == FEATURE_STORE_COLS
    assert set(got) == {"1", "3"}
    assert got["1"]["INVOICE_TO_CREDIT_RATIO"] == 0.0  # zero credit limit
    assert got["3"]["INDUSTRY_CODE"] == -1 and got["3"]["REGION_CODE"] == -1
    assert got["1"]["INDUSTRY_CODE"] == 0 and got["1"]["IS_MONTH_END"] == 1 and got["1"]["IS_QUARTER_END"] == 1
    assert got["1"]["INVOICE_DOW"] == 0 and got["1"]["IS_MONDAY"] == 1  # 2022-03-28 is a Monday
    assert abs(got["1"]["LOG_CASH_POSITION"] - 1.791759469228055) < 1e-12


def test_time_split_is_exact_and_ordered(spark):
    from tests.conftest import SF_SMALL
    from arledger.plans.inputs import Inputs

    inp = Inputs(spark, SF_SMALL)
    sp = features.time_split(inp.feature_store)
    n = sp.count()
    counts = {r["split"]: r["c"] for r in sp.groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert counts["train"] == int(n * 0.8)
    mx = sp.where("split = 'train'").agg(F.max("BLDAT")).first()[0]
    mn = sp.where("split = 'test'").agg(F.min("BLDAT")).first()[0]
    assert mx <= mn


def test_amount_bucket_duplicate_edges(spark):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([1, 1, 1, 1, 1, 1, 2, 3, 4, 5])],
                               "BELNR string, DMBTR double")
    got = {r["BELNR"]: r["AMOUNT_BUCKET"] for r in features.amount_bucket(df).collect()}
    assert got["0"] == 0 and got["9"] == max(got.values())


def test_time_split_with_hot_boundary_day(spark):
    rows = []
    for i in range(1000):
        # 480 rows before 2022-01-25, 420 on it: the 800-row cut falls inside the hot day
        day = D(2022, 1, 25) if i % 5 < 2 else D(2022, 1, 1) + dt.timedelta(days=i % 30)
        rows.append((f"{i:05d}", day))
    df = spark.createDataFrame(rows, "BELNR string, BLDAT date")
    sp = features.time_split(df)
    got = {r["BELNR"]: r["split"] for r in sp.collect()}
    assert len(got) == 1000
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    expect = {b: ("train" if i < 800 else "test") for i, (b, _) in enumerate(ordered)}
    assert got == expect


@pytest.mark.parametrize("partitions", [2, 8, 64])
def test_time_split_is_exact_at_size(spark, partitions):
    """2M rows, 40 % of them on the boundary day, with repeated keys and wide rows."""
    n = 2_000_000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        i = F.col("id")
        day = F.when(i % 10 < 4, F.lit(20)).when(i % 10 < 9, i % 20).otherwise(F.lit(21) + i % 5).cast("int")
        rows = spark.range(n).select(
            (F.xxhash64(i) % 1_900_000).alias("BELNR"), F.lit("001").alias("BUZEI"),
            F.date_add(F.lit("2022-01-01"), day).alias("BLDAT"),
            *[F.xxhash64(i, F.lit(k)).alias(f"wide{k}") for k in range(6)], i,
        )
        split = features.time_split(rows)
        cut = int(n * 0.8)
        got = split.groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).collect()
        assert {r["split"]: r["n"] for r in got} == {"train": cut, "test": n - cut}
        again = split.select("id", "split").groupBy("split").agg(F.sum("id").alias("ids")).collect()
        assert {r["split"]: r["ids"] for r in got} == {r["split"]: r["ids"] for r in again}
        key = F.struct("BLDAT", "BELNR", "BUZEI")
        assert split.where("split = 'train'").agg(F.max(key)).first()[0] <= split.where("split = 'test'").agg(F.min(key)).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("partitions", [2, 64])
def test_folds_are_exactly_stratified(spark, partitions, monkeypatch):
    from arledger.operators import classify

    monkeypatch.setattr(classify, "FOLD_GROUP_ROWS", 5_000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(300_001).select(F.col("id").alias("BELNR"), (F.col("id") % 7 == 0).cast("double").alias("LATE_FLAG"))
        folds = classify.stratified_folds(rows, 5)
        sizes = folds.groupBy("LATE_FLAG", "fold").count().collect()
        for label in (0.0, 1.0):
            n = [r["count"] for r in sizes if r["LATE_FLAG"] == label]
            assert len(n) == 5 and max(n) - min(n) <= 1
        assert folds.where("fold = 2").agg(F.sum("BELNR")).first() == folds.select("BELNR", "fold").where("fold = 2").agg(F.sum("BELNR")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_quantiles_with_a_hot_value(spark):
    """75 % of the rows hold one value: counted before the shuffle, and exact in every group."""
    import numpy as np

    from arledger.operators import stats

    rows = spark.range(200_000).select(
        F.when(F.col("id") % 4 < 3, F.lit(5.0)).otherwise(F.col("id") % 1000 / 7.0).alias("v"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("g"),
    )
    got = {r["g"]: r for r in stats.exact_quantiles(rows, "v", [0.0, 0.1, 0.37, 0.5, 0.9, 1.0], ["g"]).collect()}
    data = rows.toPandas()
    for g, part in data.groupby("g", dropna=False)["v"]:
        key = None if g != g else int(g)
        want = np.quantile(part, [0.0, 0.1, 0.37, 0.5, 0.9, 1.0])
        assert got[key]["n"] == len(part) and np.allclose([got[key][f"q{i}"] for i in range(6)], want, rtol=1e-12)
    ranged = stats.running_counts(rows, ["v"])
    assert ranged.count() == rows.select("v").distinct().count() and ranged.agg(F.max("upto")).first()[0] == 200_000


def test_asof_history_matches_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        day = D(2022, 1, 1) + dt.timedelta(days=rnd.randrange(60))
        rows.append((f"{i:04d}", "001", "hot" if rnd.random() < 0.4 else f"c{rnd.randrange(9)}", day, None if rnd.random() < 0.05 else day + dt.timedelta(days=rnd.randrange(0, 40)),
                     None if rnd.random() < 0.1 else float(rnd.randrange(-5, 30)), 10.0 * i))
    rows = [(*r[:5], r[5], None if r[5] is None else float(r[5] > 0), r[6]) for r in rows]
    df = spark.createDataFrame(rows, "BELNR string, BUZEI string, KUNNR string, BLDAT date, AUGDT date, DAYS_LATE double, LATE_FLAG double, DMBTR double")
    got = {r["BELNR"]: r for r in features.customer_history(df, asof=True).collect()}
    mean = lambda v: sum(v) / len(v) if v else None
    for r in rows:
        known = sorted([x for x in rows if x[2] == r[2] and x[4] is not None and x[4] < r[3]], key=lambda x: (x[4], x[3], x[0], x[1]))
        avg = mean([x[5] for x in known if x[5] is not None]) or 0.0
        rate = mean([x[6] for x in known if x[6] is not None]) or 0.0
        roll = mean([x[5] for x in known[-3:] if x[5] is not None])
        g = got[r[0]]
        assert abs(g["CUST_AVG_DAYS_LATE"] - avg) < 1e-9 and abs(g["CUST_LATE_RATE"] - rate) < 1e-9
        assert abs(g["CUST_ROLLING3_DAYS_LATE"] - (avg if roll is None else roll)) < 1e-9


def test_kept_codes_hold_for_new_data(spark):
    old = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", None)], "INDUSTRY string, REGION string")
    new = spark.createDataFrame([("C", "y"), ("D", None)], "INDUSTRY string, REGION string")
    kept = features.category_mapping(old)
    got = {r["INDUSTRY"]: (r["INDUSTRY_CODE"], r["REGION_CODE"]) for r in features.category_codes(new, mapping=kept).collect()}
    assert got == {"C": (2, 1), "D": (-1, -1)}
    many = spark.range(1500).select(F.format_string("%05d", "id").alias("INDUSTRY"), F.lit("x").alias("REGION"))
    codes = features.category_codes(many)
    assert codes.where(F.col("INDUSTRY").cast("int") != F.col("INDUSTRY_CODE")).count() == 0 and codes.count() == 1500


@pytest.mark.parametrize("text_numbers", [False, True])
def test_one_customer_day_is_split_into_blocks(spark, monkeypatch, text_numbers):
    """Half of all rows on one customer-day: history over several blocks equals the single window's, and no
    window group holds the day."""
    import random

    from arledger.operators import features

    monkeypatch.setattr(features, "BLOCK_DOCUMENTS", 7)
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        hot = i % 2 == 0
        number = 1_800_000_000 + i * 37
        rows.append((str(number) if text_numbers else i * 3, "001", "C1" if hot else f"C{rnd.randrange(5)}",
                     "2024-03-01" if hot else f"2024-0{rnd.randint(1, 5)}-1{rnd.randrange(3)}", rnd.choice([None, -3.0, 0.0, 4.0, 21.0]), rnd.choice([0, 1, 1]), round(rnd.random() * 1000, 2)))
    if text_numbers:
        monkeypatch.setattr(features, "BLOCK_PREFIX", 8)
    kind = "string" if text_numbers else "long"
    df = spark.createDataFrame(rows, f"BELNR {kind}, BUZEI string, KUNNR string, BLDAT string, DAYS_LATE double, LATE_FLAG int, DMBTR double").withColumn("BLDAT", F.col("BLDAT").cast("date"))
    blocks = df.where("KUNNR = 'C1' and BLDAT = '2024-03-01'").groupBy(features.document_block(df, ["BELNR", "BUZEI"])).count()
    assert blocks.count() > 20 and blocks.agg(F.max("count")).first()[0] < 40
    got = features.customer_history(df).orderBy("BELNR").collect()
    want = features.customer_history_single_window(df).orderBy("BELNR").collect()
    assert len(got) == len(want) == 400 and "_block" not in got[0].asDict()
    for g, w in zip(got, want, strict=True):
        for c in ("CUST_AVG_DAYS_LATE", "CUST_LATE_RATE", "CUST_INVOICE_COUNT", "CUST_AVG_AMOUNT", "CUST_TOTAL_EXPOSURE", "CUST_ROLLING3_DAYS_LATE", "CUST_MAX_INVOICE", "CUST_LATE_TREND"):
            assert g[c] == pytest.approx(w[c], abs=1e-9), (c, g, w)
