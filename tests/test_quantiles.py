"""Exact quantiles from brackets against numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arledger.operators import stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def data(kind, n, rnd):
    if kind == "spread":
        return [rnd.gauss(0, 1) for _ in range(n)]
    if kind == "ties":
        return [float(rnd.randrange(4)) for _ in range(n)]
    if kind == "one value":
        return [7.0] * n
    return [5.0] * (n * 6 // 10) + [rnd.expovariate(1) * 100 for _ in range(n - n * 6 // 10)]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_of_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    rnd = random.Random(7)
    groups = {(kind, n): data(kind, n, rnd) for kind in ("spread", "ties", "one value", "hot") for n in (1, 2, 3, 101, 3000)}
    groups[(None, 0)] = [rnd.random() for _ in range(700)]
    rows = [(g, n, v) for (g, n), values in groups.items() for v in values] + [("spread", 1, None), ("nothing", 5, None), ("spread", 3000, float("nan"))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, size long, value double").repartition(6)
    got = {(r["g"], r["size"]): r for r in stats.exact_quantiles(df, "value", PROBS, ["g", "size"]).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        assert [got[key][f"q{i}"] for i in range(len(PROBS))] == pytest.approx(np.quantile(values, PROBS).tolist(), abs=1e-12)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_of_a_column(spark, monkeypatch, accuracy):
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    values = data("hot", 9000, random.Random(1))
    df = spark.createDataFrame([(v,) for v in values], "value double")
    row = stats.exact_quantiles(df, "value", PROBS).first()
    assert [row[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(np.quantile(values, PROBS).tolist(), abs=1e-12) and row["n"] == 9000
    none = stats.exact_quantiles(df.where("value is null"), "value", [0.5]).first()
    assert none is None or none["q0"] is None


def test_only_the_brackets_are_ranked(spark, monkeypatch):
    seen = []
    plain = stats.running_counts
    monkeypatch.setattr(stats, "running_counts", lambda df, order: seen.append(df.count()) or plain(df, order))
    df = spark.range(60_000).select((F.xxhash64("id") % 1_000_000).cast("double").alias("value"))
    row = stats.exact_quantiles(df, "value", [0.25, 0.5]).first()
    values = [r[0] for r in df.collect()]
    assert [row["q0"], row["q1"]] == pytest.approx(np.quantile(values, [0.25, 0.5]).tolist())
    assert seen[0] < 60_000 * 2 * 12 / stats.ACCURACY + 100
