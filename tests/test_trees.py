"""The boosted trees' own fit against MLlib's, on made rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arledger.constants import FEATURE_COLS
from arledger.operators import classify, trees

CFG = classify.ClassifierConfig(max_depth=5, n_rounds=6)


def _rows(spark, n: int, partitions: int, weight: float = 1.37):
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        x = [round(rnd.gauss(0, 2), 2) if c % 3 else float(rnd.randrange(4)) for c in range(len(FEATURE_COLS))]
        rows.append((i, int(sum(x[:4]) + rnd.gauss(0, 2) > 2), *x))
    df = spark.createDataFrame(rows, "BELNR long, LATE_FLAG int, " + ", ".join(f"{c} double" for c in FEATURE_COLS))
    df = classify.assemble(df.repartition(partitions, "BELNR").sortWithinPartitions("BELNR"))
    return df.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0)).persist()


def _nodes(model, spark):
    return [(w, [(i, r["leftChild"], r["rightChild"], r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"], r["rawCount"]) for i, r in sorted(t.items())],
             [r["prediction"] for _, r in sorted(t.items())], [(r["impurity"], r["gain"]) for _, r in sorted(t.items())]) for w, t in classify.tree_nodes(model, spark)]


def _same(a, b, close=1e-9):
    assert len(a) == len(b)
    for (wa, na, pa, ia), (wb, nb, pb, ib) in zip(a, b, strict=True):
        assert wa == wb and na == nb
        assert np.allclose(pa, pb, atol=close, rtol=0) and np.allclose(ia, ib, atol=close, rtol=0)


def test_trees_of_one_partition_are_those_of_mllib(spark):
    data = _rows(spark, 700, 1)
    est = classify._gbt(CFG)
    model = trees.Fit(est, data, CFG.features).go_on(est)
    want = est.fit(data)
    _same(_nodes(model, spark), _nodes(want, spark), 1e-12)
    assert model.extractParamMap().keys() and model.getNumTrees == 6 and model.numFeatures == 12 and model.uid == est.uid
    assert np.allclose(model.featureImportances.toArray(), want.featureImportances.toArray())
    a, b = (sorted((r["BELNR"], round(r["MARGIN"], 9)) for r in classify.margin(m.transform(data)).collect()) for m in (model, want))
    assert a == b
    data.unpersist()


def test_dealt_rows_give_the_same_trees(spark, monkeypatch):
    """Several tasks or one, at once or in steps: the same sums, so the same trees; the first begins as MLlib's (later nodes have ties)."""
    data = _rows(spark, 900, 3)
    est, early = classify._gbt(CFG), classify._gbt(CFG, 2)
    alone = _nodes(trees.Fit(est, data, CFG.features).go_on(est), spark)
    monkeypatch.setattr(trees, "TASK_ROWS", 10)
    fit = trees.Fit(est, data, CFG.features)
    assert len(_nodes(fit.go_on(early), spark)) == 2
    _same(_nodes(fit.go_on(est), spark), alone, 0)
    mllib = _nodes(est.fit(data), spark)
    assert alone[0][1][0] == mllib[0][1][0] and abs(alone[0][2][0] - mllib[0][2][0]) < 1e-9 and abs(alone[0][3][0][1] - mllib[0][3][0][1]) < 1e-9
    data.unpersist()


def test_lost_files_are_made_again(tmp_dir):
    codes = np.random.default_rng(1).integers(0, 8, (3, 500)).astype(np.uint8)
    codes = codes & 0xFE | (codes[0] >> 2)
    plan = trees.Plan([[0.0, 1.0, 2.0]] * 3, 3, 4, 3, 0.05, 0.8, 5, 42, (1.0, 2.0), 30)
    routes = [trees.Routes(t) for _, t, _ in trees.fit_alone({0: codes}, [], plan)]
    steps = trees.Kept(tmp_dir + "/a", 0, codes, plan, routes)
    by_step = [steps.score(m) for m in range(5)]
    for m in range(4):
        steps.forget(m)
    at_once = trees.Kept(tmp_dir + "/b", 0, codes, plan, routes)
    assert all((at_once.score(m) == by_step[m]).all() for m in (4, 2, 3))
    assert (steps.score(2) == by_step[2]).all()
    for a, b in zip(steps.sampled(3)[1], at_once.sampled(3)[1], strict=True):
        assert (a == b).all()
    assert (steps.squares(3) == at_once.squares(3)).all()


@pytest.mark.parametrize("n", [1, 15, 16, 1000, 5000])
def test_lanes_draw_one_sequence(n):
    state, want = trees.hash_seed(99), []
    for _ in range(n):
        u, state = trees._nextdouble(state)
        want.append(u < 0.8)
    assert trees.Draws(n).below(99, 0.8).tolist() == want


def test_a_fit_of_few_rows_is_not_a_job_a_level(spark):
    """MLlib runs a job for every level of every tree, and as many again for every fold."""
    data = _rows(spark, 400, 1)
    cut = data.withColumn("is_val", F.col("BELNR") % 5 == 0)
    sc = spark.sparkContext
    jobs = {}
    for rounds in (2, 12):
        sc.setJobGroup(f"trees-{rounds}", "fit")
        model, trace = classify.fit_boosted(cut, classify.ClassifierConfig(n_rounds=rounds, max_depth=5))
        jobs[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"trees-{rounds}"))
        assert len(trace) == rounds and 1 <= model.getNumTrees <= rounds
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[12] <= jobs[2] + 5
    data.unpersist()


def test_weights_that_labels_dont_tell_take_mllibs_stages(spark):
    data = _rows(spark, 200, 1).withColumn("weight", 1.0 + F.col("BELNR") % 3)
    est = classify._gbt(CFG, 2)
    _same(_nodes(trees.Fit(est, data, CFG.features).go_on(est), spark), _nodes(est.fit(data), spark))


def test_folds_score_as_the_cross_validator_does(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = _rows(spark, 600, 1)
    cfg = classify.ClassifierConfig(max_depth=3, cv_rounds=3, cv_folds=3)
    rows = data.select("BELNR", "LATE_FLAG", *FEATURE_COLS)
    frame = classify.training_frame(classify.assemble(classify.stratified_folds(rows, 3, cfg.seed)).withColumn(
        "weight", F.when(F.col("label") == 1, classify.positive_weight(rows)).otherwise(1.0)))
    cv = CrossValidator(estimator=classify._gbt(cfg, 3), estimatorParamMaps=ParamGridBuilder().build(), foldCol="fold", numFolds=3, seed=cfg.seed,
                        evaluator=BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0))
    assert abs(classify.cross_validate(rows, cfg) - float(cv.fit(frame).avgMetrics[0])) < 1e-9
    frame.unpersist()
    data.unpersist()
