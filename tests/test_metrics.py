"""Evaluation operators against brute-force computations on small data."""

from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from arledger.operators import metrics, stats


def _frame(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1.0 if rnd.random() < 0.6 else 0.0
        p = round(min(1.0, max(0.0, rnd.gauss(0.55 + 0.2 * y, 0.2))), 2)  # coarse: many ties
        rows.append((str(i), y, p, int(p >= 0.5), float(i)))
    return spark.createDataFrame(rows, "BELNR string, LATE_FLAG double, LATE_PROB double, LATE_PRED int, DMBTR double"), rows


def _auc_brute(rows):
    pos = [r[2] for r in rows if r[1] == 1]
    neg = [r[2] for r in rows if r[1] == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _ap_brute(rows):
    P = sum(1 for r in rows if r[1] == 1)
    ap = 0.0
    for t in sorted({r[2] for r in rows}, reverse=True):
        tp = sum(1 for r in rows if r[2] >= t and r[1] == 1)
        fp = sum(1 for r in rows if r[2] >= t and r[1] == 0)
        pos_here = sum(1 for r in rows if r[2] == t and r[1] == 1)
        ap += pos_here / P * tp / (tp + fp)
    return ap


def test_auc_ap_brier(spark):
    df, rows = _frame(spark)
    m = metrics.ranking_metrics(df).first()
    assert abs(m["auc_roc"] - _auc_brute(rows)) < 1e-12
    assert abs(m["auc_pr"] - _ap_brute(rows)) < 1e-12
    assert abs(m["brier"] - np.mean([(r[2] - r[1]) ** 2 for r in rows])) < 1e-12


def test_confusion_and_report(spark):
    df, rows = _frame(spark)
    c = metrics.confusion(df).first()
    assert c["tn"] + c["fp"] + c["fn"] + c["tp"] == len(rows)
    rep = {r["label"]: r for r in metrics.classification_report(df).collect()}
    assert rep["Late"]["support"] + rep["On time"]["support"] == len(rows)
    assert abs(rep["Late"]["precision"] - c["tp"] / (c["tp"] + c["fp"])) < 1e-12


def test_grids_and_threshold(spark):
    df, rows = _frame(spark)
    assert len(metrics.threshold_grid()) == 61 and abs(metrics.threshold_grid()[-1] - 0.8) < 1e-9
    assert len(metrics.sensitivity_grid()) == 80
    g = {r["k"]: r for r in metrics.grid_metrics(df, metrics.threshold_grid()).collect()}
    for k in (0, 17, 60):
        t = metrics.threshold_grid()[k]
        tp = sum(1 for r in rows if r[2] >= t and r[1] == 1)
        fl = sum(1 for r in rows if r[2] >= t)
        assert abs(g[k]["flag_rate"] - fl / len(rows)) < 1e-12
        assert abs(g[k]["precision"] - (tp / fl if fl else 0.0)) < 1e-12
    best = metrics.optimize_threshold(df).first()
    assert 0.2 <= best["threshold"] <= 0.81
    assert best["flag_rate"] <= best["max_flag_rate"] or best["flag_rate"] <= 0.95


def test_calibration_bins_right_closed(spark):
    df = spark.createDataFrame([(1.0, 0.1), (0.0, 0.1000001), (1.0, 1.0), (0.0, 0.0)], "LATE_FLAG double, LATE_PROB double")
    got = {r["bin"]: r["n"] for r in metrics.calibration_curve(df).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(11)
    vals = [(("a" if i % 3 else "b"), float(rnd.randint(0, 50))) for i in range(1001)]
    df = spark.createDataFrame(vals, "g string, x double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in stats.exact_quantiles(df, "x", qs, ["g"]).collect()}
    for g in ("a", "b"):
        xs = np.array([v for k, v in vals if k == g])
        for i, q in enumerate(qs):
            assert abs(got[g][f"q{i}"] - float(np.percentile(xs, q * 100))) < 1e-9


def test_running_counts_are_a_permutation(spark):
    """400,000 keys, more than the range sampler sees: every rank occurs once, in the keys' order."""
    df = spark.range(400_000).selectExpr("id % 7 AS k", "id")
    r = stats.running_counts(df, ["k", "id"])
    got = r.agg(F.count("*").alias("n"), F.countDistinct("upto").alias("d"), F.max("upto").alias("m")).first()
    assert (got["n"], got["d"], got["m"]) == (400_000, 400_000, 400_000)
    per = 400_000 // 7 + 1
    wrong = r.where("upto <> id div 7 + 1 + k * %d - greatest(k - %d, 0)" % (per, 400_000 % 7))
    assert wrong.count() == 0


def test_pinball(spark):
    df = spark.createDataFrame([(10.0, 8.0), (10.0, 12.0)], "y double, yhat double")
    got = metrics.pinball_loss(df, "y", "yhat", 0.9).first()["pinball_loss"]
    assert abs(got - (0.9 * 2 + 0.1 * 2) / 2) < 1e-12


def test_grid_place_is_exact(spark):
    """The computed place equals a walk along the grid, on and next to every grid point."""
    import numpy as np

    for grid in (metrics.threshold_grid(), metrics.sensitivity_grid(), metrics.calibration_edges()):
        xs = sorted({float(x) for g in grid for x in (g, np.nextafter(g, 0), np.nextafter(g, 1))} | {0.0, 1.0, -3.0, 7.5})
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        for strict in (False, True):
            got = {r["x"]: r["n"] for r in df.select("x", metrics._count_le(grid, F.col("x"), strict).alias("n")).collect()}
            assert got == {x: sum((g < x) if strict else (g <= x) for g in grid) for x in xs}
