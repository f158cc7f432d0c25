"""Quantile boosting: splits, leaf values, patience and scoring against plain recomputations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arledger.operators import boosting
from arledger.operators.boosting import BoostConfig

FEATURES = ["x0", "x1", "x2"]


def series(seed: int, n: int = 90, later: int = 20):
    rnd = random.Random(seed)
    x = np.array([[rnd.gauss(0, 1), rnd.randrange(5), rnd.random()] for _ in range(n)])
    x[3, 0] = x[n - 2, 2] = np.nan
    y = np.where(np.nan_to_num(x[:, 0], nan=9.0) > 0.2, 10.0, 2.0) + x[:, 1] + np.array([rnd.gauss(0, 0.5) for _ in range(n)])
    return x, y, np.arange(n) < n - later


def plain_split(x, over, q, least):
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in sorted(set(x[~np.isnan(x[:, f]), f])):
            left = x[:, f] <= cut
            if left.sum() < least or (~left).sum() < least:
                continue
            part = lambda m: (over[m].sum() - q * m.sum()) ** 2 / m.sum()
            gain = round(part(left) + part(~left) - part(left | ~left), 9)
            if gain > best[0]:
                best = (gain, f, cut)
    return best


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_first_split_is_the_best_one(q):
    x, y, train = series(1)
    cfg = BoostConfig(n_rounds=1, max_depth=1, min_rows=7)
    found = list(boosting.boost(x, y, np.ones(len(y), bool), q, cfg))
    start = np.quantile(y, q)
    gain, f, cut = plain_split(x, (start >= y).astype(float), q, 7)
    assert found[0][:2] == (0, start)
    (left, right), values = [b for *_, b, _ in found[1:]], [v for _, v, *_ in found[1:]]
    assert left == {f: (-np.inf, cut)} and right == {f: (cut, np.inf)}
    side = x[:, f] <= cut
    assert np.allclose(values, [0.05 * np.quantile((y - start)[side], q), 0.05 * np.quantile((y - start)[~side], q)])


def test_leaves_partition_the_rows_and_patience_ends_the_fit():
    x, y, train = series(2, 200, 60)
    cfg = BoostConfig(min_rows=5, patience=5)
    trees: dict = {}
    for k, value, n, box, loss in boosting.boost(x, y, train, 0.5, cfg):
        trees.setdefault(k, []).append((value, n, box, loss))
    filled = np.where(np.isnan(x), np.inf, x)
    fit = np.zeros(len(y))
    losses = []
    for k in sorted(trees):
        met = np.array([boosting.inside(filled, box) for _, _, box, _ in trees[k]])
        assert (met.sum(0) == 1).all() and len(trees[k]) <= cfg.max_leaves
        assert [int(m[train].sum()) for m in met] == [n for _, n, _, _ in trees[k]] and (k == 0 or min(n for _, n, _, _ in trees[k]) >= 5)
        fit += sum(m * v for m, (v, *_) in zip(met, trees[k], strict=True))
        losses.append(boosting.pinball((y - fit)[~train], 0.5))
        assert abs(losses[-1] - trees[k][0][3]) < 1e-9
    assert losses[-1] == min(losses) < 0.6 * losses[0] and len(trees) < cfg.n_rounds + 1


def test_no_split_no_rows_and_equal_targets():
    x, y, train = series(3, 10, 0)
    assert [k for k, *_ in boosting.boost(x, y, train, 0.5, BoostConfig(n_rounds=2, min_rows=20))] == [0, 1, 2]
    assert list(boosting.boost(x, y, ~train, 0.5, BoostConfig())) == []
    flat = list(boosting.boost(x, np.ones(10), train, 0.9, BoostConfig(n_rounds=3, min_rows=2)))
    assert sum(v for _, v, *_ in flat) == pytest.approx(1.0)


def test_bins_of_many_values_keep_the_ends():
    values = np.append(np.arange(1000.0), np.nan)
    edges = boosting.bin_edges(values, 50)
    assert len(edges) == 50 and edges[0] == 0 and edges[-1] == 999


def test_models_are_fitted_in_one_job_and_scored_by_join(spark):
    rows = []
    for m in range(6):
        x, y, train = series(m)
        for i in range(len(y)):
            rows += [(f"m{m}", h, bool(train[i]), float(y[i] * h), i, *[None if np.isnan(v) else float(v) for v in x[i]]) for h in (1, 2)]
    df = spark.createDataFrame(rows, "model string, horizon int, is_train boolean, target double, i int, x0 double, x1 double, x2 double")
    cfg = BoostConfig(n_rounds=20, min_rows=5)
    trees = boosting.fit_models(df.repartition(5), FEATURES, [0.1, 0.9], cfg, ("i",)).cache()
    again = boosting.fit_models(df.repartition(2), FEATURES, [0.1, 0.9], cfg, ("i",))
    assert sorted(map(repr, trees.collect())) == sorted(map(repr, again.collect()))
    got = {(r.model, r.horizon, r.quantile, r.i): r.prediction for r in boosting.predict(df, trees, FEATURES, ["i"]).collect()}
    assert len(got) == 6 * 2 * 2 * 90
    for m in range(6):
        x, y, train = series(m)
        filled = np.where(np.isnan(x), np.inf, x)
        want = sum(boosting.inside(filled, box) * v for _, v, _, box, _ in boosting.boost(x, y * 2, train, 0.9, cfg))
        assert np.allclose([got[(f"m{m}", 2, 0.9, i)] for i in range(90)], want)
    assert trees.where("tree = 0").groupBy("model").count().where("count <> 4").count() == 0


def test_training_has_no_job_per_segment(spark):
    """As many jobs for many segment models as for none."""
    from arledger.operators import forecast
    from arledger.plans.inputs import Inputs

    monthly = Inputs(spark, "/root/testdata/sf0.01").monthly
    only = monthly.where("ALL_INDUSTRY = 1 and (ALL_REGION = 1 or REGION = 'ASIA')")
    tracker, counts = spark.sparkContext.statusTracker(), []
    for i, data in enumerate((only, monthly)):
        spark.sparkContext.setJobGroup(f"fit-{i}", "")
        fc = forecast.train_forecaster(data, forecast.ForecastConfig(BoostConfig(n_rounds=3)))
        counts.append((len(tracker.getJobIdsForGroup(f"fit-{i}")), len(fc.models)))
    spark.sparkContext.setJobGroup(None, None)
    assert counts[1][1] > counts[0][1] and counts[1][0] <= counts[0][0] + 2


def test_selections_resolve_together(spark):
    from arledger.operators import forecast
    from arledger.plans.inputs import Inputs

    inp = Inputs(spark, "/root/testdata/sf0.01")
    asked = [(None, None), ("ASIA", " all "), (" ASIA", None), ("Nowhere", None), (None, "Nothing"), ("ASIA", "Nothing")]
    out = forecast.generate_forecasts(inp.forecaster, inp.monthly, asked).collect()
    assert len(out) == 3 * len(asked)
    by = {(r.Selected_Region, r.Selected_Industry): r for r in out if r.Horizon_Days == 30}
    assert by[("ASIA", " all ")].Model_Source == "segment" and by[("Nowhere", "All")].Model_Source == "global"
    assert by[("Nowhere", "All")].Inference_Slice == "portfolio (fallback: selected slice has 0 months < 12)"
    assert by[("All", "All")].Inference_Slice == "portfolio" and by[(" ASIA", "All")].Median_50pct == by[("ASIA", " all ")].Median_50pct
    assert all(0 <= r.Lower_10pct <= r.Median_50pct <= r.Upper_90pct for r in out)


def test_pooled_global_model(spark):
    from arledger.operators import forecast, monthly
    from arledger.plans.inputs import Inputs

    series_ = Inputs(spark, "/root/testdata/sf0.01").monthly
    summary = monthly.segment_summary(series_)
    rows = forecast.model_rows(series_, summary, (30,), pooled=True)
    kept = summary.where("kept_for_pooling").count()
    assert rows.where("model = 'global'").select("REGION").distinct().count() == kept > 1
    none = forecast.model_rows(series_, summary.withColumn("kept_for_pooling", F.lit(False)), (30,), pooled=True)
    assert none.where("model = 'global'").select("ALL_REGION").distinct().collect()[0][0] == 1
