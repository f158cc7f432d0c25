"""Model invariants (the reference's own test assertions) on sf0.001."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arledger.constants import FEATURE_COLS
from arledger.operators import attribution, forecast, monthly
from arledger.plans.inputs import Inputs
from tests.conftest import SF_MEDIUM, SF_SMALL


@pytest.fixture(scope="module")
def inp(spark):
    return Inputs(spark, SF_SMALL)


def test_classifier_outputs(inp):
    m = inp.classifier
    assert 0.2 <= m.threshold <= 0.81
    sc = inp.model_scored
    assert sc.count() == inp.feature_store.count()
    bad = sc.where((F.col("LATE_PROB") < 0) | (F.col("LATE_PROB") > 1) | ~F.col("LATE_PRED").isin(0, 1)).count()
    assert bad == 0
    labels = {r[0] for r in sc.select("RISK_LABEL").distinct().collect()}
    assert labels <= {"Low", "Medium", "High", None}
    metrics_row = entry.queries()["e1_e5_model_test_metrics"](inp.spark, SF_SMALL).first()
    assert metrics_row["auc_roc"] > 0.65
    assert metrics_row["tn"] + metrics_row["fp"] + metrics_row["fn"] + metrics_row["tp"] == \
        sc.where("split = 'test'").count()


def test_model_save_load(inp, tmp_dir):
    from arledger.operators.classify import TrainedClassifier

    m = inp.classifier
    m.save(tmp_dir + "/clf")
    back = TrainedClassifier.load(tmp_dir + "/clf")
    a = m.predict(inp.split).select("BELNR", "LATE_PROB").orderBy("BELNR").limit(50).collect()
    b = back.predict(inp.split).select("BELNR", "LATE_PROB").orderBy("BELNR").limit(50).collect()
    assert a == b and back.threshold == m.threshold


def test_forecast_bounds(inp):
    fc = forecast.generate_forecast(inp.forecaster, inp.monthly).orderBy("Horizon_Days").collect()
    assert [r["Horizon_Days"] for r in fc] == [30, 60, 90]
    for r in fc:
        assert 0 <= r["Lower_10pct"] <= r["Median_50pct"] <= r["Upper_90pct"]
        assert r["Range_Width"] >= 0 and r["Uncertainty_Pct"] >= 0
    models = inp.forecaster.models
    assert ("global", 30) in models and len([k for k in models if k[0] == "global"]) == 3
    res = inp.forecaster.results.collect()
    assert all(r["pinball_loss"] >= 0 for r in res)


def test_forecast_region_fallback(inp):
    out = forecast.generate_forecast(inp.forecaster, inp.monthly, region="No Such Region").collect()
    assert {r["Model_Source"] for r in out} == {"global"}


def test_attribution_additivity_and_report(inp):
    top = attribution.top_flagged(inp.model_scored, 5)
    bg = attribution.background(inp.feature_store)
    phi, base = attribution.shapley(attribution.tree_scorer(inp.classifier), top, bg, n_samples=8)
    assert phi.where("phi_se < 0 or phi_se is null").count() == 0
    j = phi.groupBy("BELNR").agg(F.sum("phi_margin").alias("s"), F.count(F.lit(1)).alias("n")).join(base, "BELNR")
    rows = j.collect()
    assert len(rows) == top.count() and all(r["n"] == 12 for r in rows)
    for r in rows:
        assert abs(r["s"] + r["base_margin"] - r["f_margin"]) < 1e-5
    report = entry.queries()["x7_risk_report"](inp.spark, SF_SMALL).collect()
    assert 0 < len(report) <= 20
    for r in report:
        assert len(r["SHAP_VALUES"]) == 12
        assert "Late probability:" in r["NARRATIVE"] and "Suggested actions:" in r["NARRATIVE"]
    checks = entry.queries()["x11_audit_checks"](inp.spark, SF_SMALL).collect()
    assert len(checks) == 6 and {c["status"] for c in checks} <= {"PASS", "FAIL", "SKIP"}


def test_attribution_keeps_the_lines_of_a_document_apart(inp):
    two = inp.feature_store.limit(30).withColumn("BUZEI", F.explode(F.array(F.lit("001"), F.lit("002"))))
    two = two.withColumn("CUST_LATE_RATE", F.when(F.col("BUZEI") == "002", F.lit(0.9)).otherwise(F.lit(0.1)))
    bg = attribution.background(inp.feature_store, 7)
    weights = [0.1 * (i + 1) for i in range(12)]
    phi, base = attribution.shapley(attribution.linear_scorer(weights), two, bg, n_samples=16)
    j = phi.groupBy("BELNR", "BUZEI").agg(F.sum("phi_margin").alias("s"), F.count("*").alias("n")).join(base, ["BELNR", "BUZEI"]).collect()
    assert len(j) == 60 and all(r["n"] == 12 and abs(r["s"] + r["base_margin"] - r["f_margin"]) < 1e-6 for r in j)
    exact = two.select("BELNR", "BUZEI", sum((F.lit(w) * F.col(c).cast("double") for w, c in zip(weights, FEATURE_COLS)), F.lit(0.0)).alias("f"))
    assert exact.join(base, ["BELNR", "BUZEI"]).where("abs(f - f_margin) > 1e-6").count() == 0


def test_isotonic_calibration_is_monotone(inp, tmp_dir):
    from arledger.operators import classify

    train = inp.split.where("split = 'train'").drop("split")
    model = classify.train_classifier(train, classify.ClassifierConfig(calibration="isotonic", n_rounds=5))
    model.save(tmp_dir + "/iso")
    back = classify.TrainedClassifier.load(tmp_dir + "/iso")
    assert back.config == model.config
    rows = back.raw_probability(inp.split).select("MARGIN", "RAW_PROB").orderBy("MARGIN").collect()
    assert all(0 <= r["RAW_PROB"] <= 1 for r in rows)
    assert all(a["RAW_PROB"] <= b["RAW_PROB"] + 1e-12 for a, b in zip(rows, rows[1:]))


def test_cv_auc_is_near_the_test_auc(spark):
    """On enough rows for it (sf0.01)."""
    auc = entry.queries()["e1_e5_model_test_metrics"](spark, SF_MEDIUM).first()["auc_roc"]
    table = {r["metric"]: r["value"] for r in entry.queries()["p12_report_summary_table"](spark, SF_MEDIUM).collect()}
    assert table["Model CV AUC-ROC"] is not None and abs(table["Model CV AUC-ROC"] - auc) < 0.08


def test_widths_do_not_collapse_with_the_horizon(inp):
    fc = {r["Horizon_Days"]: r["Range_Width"] for r in forecast.generate_forecast(inp.forecaster, inp.monthly).collect()}
    assert fc[90] >= 0.6 * fc[30]


def test_saved_classifier_is_found_by_another_application(inp):
    from arledger.operators.classify import TrainedClassifier
    from arledger.session import digest, models_dir

    model = inp.classifier
    folder = models_dir(inp.spark, "classifier", SF_SMALL)
    assert folder.endswith(f"classifier-{digest(SF_SMALL)}") and digest("x") == "2d711642b726b044"
    back = TrainedClassifier.load(f"{folder}/{inp.spark.sparkContext.applicationId}")
    assert back.threshold == model.threshold and back.config == model.config


def test_narrative_text(spark):
    from arledger.functions.narrative import narrative

    row = dict(LOG_AMOUNT=11.9, PAYMENT_DAYS_NUM=14, INDUSTRY_CODE=5, REGION_CODE=2, CUST_AVG_DAYS_LATE=23.875,
               CUST_LATE_RATE=0.875, CUST_INVOICE_COUNT=8, CUST_AVG_AMOUNT=127211.93, INVOICE_MONTH=6,
               INVOICE_QUARTER=2, INVOICE_DOW=5, IS_QUARTER_END=1, DMBTR=160432.54, CUST_LATE_TREND=-8.5,
               CUST_AMOUNT_CONCENTRATION=1.26, LATE_PROB=0.9677)
    phi = [0.01, -0.02, 0.0, 0.0, 0.5, 0.3, 0.0, 0.0, 0.0, 0.9, 0.0, 0.2]  # top: QUARTER (no template)
    df = spark.createDataFrame([row]).withColumn("phi", F.array(*[F.lit(v) for v in phi]))
    text = df.select(narrative(F.col("LATE_PROB"), 0.56, F.col("phi")).alias("t")).first()["t"]
    lines = text.split("\n")
    assert lines[0] == "[HIGH RISK]  Late probability: 97%"
    assert lines[1] == "Recommended action: Immediate escalation to senior collections"
    assert lines[4] == "  • Customer payment history: averaging 24 days late (stable trend)"
    assert lines[5] == "  • Customer late rate: 88% of historical invoices paid late"
    assert "  ✓ PAYMENT_DAYS_NUM: reduces risk by 0.0200" in lines
    assert lines[-3:] == ["  1. Immediate escalation to senior collections",
                          "  2. Review credit limit — customer late on >50% of invoices",
                          "  3. Flag for CFO review if not resolved within 10 days"]


def test_forecaster_save_load(inp, tmp_dir):
    from arledger.operators.forecast import Forecaster

    fc = inp.forecaster
    fc.save(tmp_dir + "/fc")
    back = Forecaster.load(tmp_dir + "/fc")
    assert set(back.models) == set(fc.models)
    a = forecast.generate_forecast(fc, inp.monthly).orderBy("Horizon_Days").collect()
    b = forecast.generate_forecast(back, inp.monthly).orderBy("Horizon_Days").collect()
    assert a == b


def test_forecast_fallback_reason(inp):
    out = forecast.generate_forecast(inp.forecaster, inp.monthly, region="No Such Region").collect()
    assert all(r["Inference_Slice"].startswith("portfolio (fallback") for r in out)
    own = forecast.generate_forecast(inp.forecaster, inp.monthly).collect()
    assert {r["Inference_Slice"] for r in own} == {"portfolio"}


def test_tree_contributions_are_exact(inp):
    from itertools import combinations
    from math import factorial

    from pyspark.ml.functions import array_to_vector

    bg = attribution.background(inp.feature_store, 3)
    rows = inp.feature_store.orderBy("BELNR").limit(2)
    phi, base = attribution.model_shapley(inp.classifier, rows, bg)
    # every subset of the features switched on, averaged over the background
    n = len(FEATURE_COLS)
    x = rows.select("BELNR", F.array(*[F.col(c).cast("double") for c in FEATURE_COLS]).alias("x"))
    points = x.crossJoin(bg.select("z")).crossJoin(inp.spark.range(1 << n).select(F.col("id").alias("s")))
    mixed = F.array(*[F.when(F.col("s").bitwiseAND(1 << j) != 0, F.col("x")[j]).otherwise(F.col("z")[j]) for j in range(n)])
    scored = attribution.tree_scorer(inp.classifier)(points.withColumn("features", array_to_vector(mixed)))
    worth: dict = {}
    for r in scored.groupBy("BELNR", "s").agg(F.avg("MARGIN").alias("m")).collect():
        worth.setdefault(r["BELNR"], {})[r["s"]] = r["m"]
    got = phi.collect()
    assert len(got) == 2 * n and {r["phi_se"] for r in got} == {0.0}
    for r in got:
        j, m = r["feature_idx"], worth[r["BELNR"]]
        want = sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (m[s | 1 << j] - m[s])
                   for k in range(n) for s in (sum(1 << i for i in c) for c in combinations([i for i in range(n) if i != j], k)))
        assert abs(r["phi_margin"] - want) < 1e-9
    for r in base.collect():
        assert abs(r["base_margin"] - worth[r["BELNR"]][0]) < 1e-9 and abs(r["f_margin"] - worth[r["BELNR"]][(1 << n) - 1]) < 1e-9


def test_importance_of_the_portfolio_has_no_sampling_noise(inp):
    phi, _ = inp.portfolio_attributions
    top, exact, _ = inp.report_attributions
    assert phi.where("phi_se <> 0").count() == 0 and exact.where("phi_se <> 0").count() == 0
    assert phi.count() == 12 * inp.feature_store.count()
    out = entry.queries()["x3_global_importance"](inp.spark, SF_SMALL).collect()
    assert len(out) == 12 and {r["max_phi_se"] for r in out} == {0.0}


def test_folds_are_fitted_after_the_model_with_its_rounds(inp, tmp_dir, monkeypatch):
    from arledger.operators import classify

    assert classify.ClassifierConfig().patience == 50 and classify.ClassifierConfig().n_rounds == 500
    seen = []
    monkeypatch.setattr(classify, "cross_validate", lambda rows, cfg: seen.append(cfg.cv_rounds) or 0.75)
    train = inp.split.where("split = 'train'").drop("split")
    m = classify.train_classifier(train, classify.ClassifierConfig(n_rounds=3), with_cv=True)
    assert seen == [m.gbt.getNumTrees]
    m.save(tmp_dir + "/cv")
    assert classify.TrainedClassifier.load(tmp_dir + "/cv").cv_auc == 0.75


def test_cv_auc_is_saved_with_the_model(inp, monkeypatch):
    from arledger.operators import classify
    from arledger.plans import inputs

    monkeypatch.setattr(inputs, "_MODELS", {k: v for k, v in inputs._MODELS.items() if k[2] != "cv_auc"})
    monkeypatch.setattr(classify, "cross_validate", lambda rows, cfg: 0.75)
    assert inp.cv_auc == 0.75
    assert classify.TrainedClassifier.load(inp._classifier_path).cv_auc == 0.75


def test_best_round_waits_for_the_patience():
    from arledger.operators.classify import best_round

    rise = [(k, 0.5 + k / 1000) for k in range(1, 101)]
    assert best_round(rise, 50) == (100, False)
    assert best_round(rise + [(100 + k, 0.55) for k in range(1, 50)], 50) == (100, False)
    assert best_round(rise + [(100 + k, 0.55) for k in range(1, 51)], 50) == (100, True)
    late = rise + [(100 + k, 0.55) for k in range(1, 40)] + [(140, 0.9)] + [(140 + k, 0.9) for k in range(1, 51)]
    assert best_round(late, 50) == (140, True)
    assert best_round([(k, None) for k in range(1, 8)], 3) == (7, True)


def test_staged_auc_by_pairs(spark):
    import random

    from arledger.operators.metrics import staged_auc

    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), [round(rnd.gauss(0, 2), 3) for _ in range(4)]) for _ in range(200)] + [(1, [99.0, -99.0, 0.0, 0.0])]
    got = {r["round"]: r["auc_roc"] for r in staged_auc(spark.createDataFrame(rows, "LATE_FLAG int, MARGINS array<double>").repartition(3)).collect()}
    for k in range(4):
        pairs = [(a[1][k], b[1][k]) for a in rows for b in rows if a[0] == 1 and b[0] == 0]
        want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
        assert abs(got[k + 1] - want) < 2e-3
    assert staged_auc(spark.createDataFrame([(1, [0.1])], "LATE_FLAG int, MARGINS array<double>")).first()["auc_roc"] is None


def test_trees_after_the_best_round_are_cut(inp, tmp_dir):
    from arledger.operators import classify

    train = inp.split.where("split = 'train'").drop("split")
    m = classify.train_classifier(train, classify.ClassifierConfig(n_rounds=24, first_rounds=6, patience=4, max_depth=3))
    best, _ = classify.best_round(m.trace, 4)
    assert m.gbt.getNumTrees == best <= len(m.trace) and len(m.trace) in (6, 12, 24)
    kept = m.trace_table().where("kept").count()
    assert kept == best
    # the margins after the last kept tree are those of the cut ensemble
    rows = inp.split.where("split = 'test'").limit(200)
    staged = classify.staged_margins(rows, classify.tree_nodes(m.gbt, inp.spark), ["BELNR"]).collect()
    own = {r["BELNR"]: r["MARGIN"] for r in m.raw_probability(rows).collect()}
    assert all(abs(r["MARGINS"][-1] - own[r["BELNR"]]) < 1e-9 and len(r["MARGINS"]) == best for r in staged)
    m.save(tmp_dir + "/cut")
    back = classify.TrainedClassifier.load(tmp_dir + "/cut")
    assert back.trace == m.trace and back.gbt.getNumTrees == best and back.config == m.config


def test_one_label_keeps_all_trees(inp):
    from arledger.operators import classify

    data = classify.assemble(inp.feature_store.limit(60).withColumn("LATE_FLAG", F.lit(1))).withColumns(
        {"weight": F.lit(1.0), "is_val": F.col("BELNR") % 2 == 0})
    gbt, trace = classify.fit_boosted(data, classify.ClassifierConfig(n_rounds=2, max_depth=2))
    assert gbt.getNumTrees == 2 and all(auc is None for _, auc in trace)


def test_random_baseline_follows_the_keys(inp):
    from arledger.operators.classify import key_uniform

    u = inp.feature_store.select("BELNR", key_uniform(inp.feature_store, 42).alias("u"))
    a = {r[0]: r[1] for r in u.collect()}
    fs = inp.feature_store.repartition(7)
    b = {r[0]: r[1] for r in fs.select("BELNR", key_uniform(fs, 42).alias("u")).collect()}
    assert a == b and all(0 <= v < 1 for v in a.values()) and 0.4 < sum(a.values()) / len(a) < 0.6


def _five_lines(spark):
    rows = [(i % 4, "001", "High" if i % 2 else "Low", *[float((i * 7 + 3 * c) % 11) for c in range(12)]) for i in range(5)]  # key 0 twice
    return spark.createDataFrame(rows, ["BELNR", "BUZEI", "RISK_TIER", *FEATURE_COLS])


def test_numpy_scorer_sums_as_the_points_do(spark):
    from arledger.operators import attribution

    lines = _five_lines(spark)
    bg = attribution.background(lines, n=3)
    score = attribution.linear_scorer([0.3 * (i + 1) for i in range(12)])
    by_point = lambda df: score(df)
    got = [attribution.shapley(s, lines, bg, n_samples=5) for s in (score, by_point)]
    for a, b in zip(*got, strict=True):
        a, b = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.orderBy(*t.columns[:3]).collect()] for t in (a, b))
        assert a == b and len(a) in (48, 4)
    # every line stays one row: nothing is exploded into points before the stored table of lines
    files = got[0][1].inputFiles()
    assert files and spark.read.parquet(*files).count() == 4


def test_reports_join_lines_before_they_explode(spark):
    from arledger.operators import attribution

    lines = _five_lines(spark)
    phi, _ = attribution.shapley(attribution.linear_scorer([1.0] * 12), lines, attribution.background(lines, n=1), n_samples=2)
    report = attribution.contributions_by_tier(phi, lines)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the join is below
    plain = attribution.contributions_by_tier(spark.createDataFrame(phi.collect(), phi.schema), lines)
    rows = lambda df: sorted((r["RISK_TIER"], r["feature"], round(r["mean_phi"], 9)) for r in df.collect())
    assert rows(report) == rows(plain)
    one = attribution.dependence(phi, lines, "CUST_LATE_RATE", "LOG_AMOUNT")
    assert "Generate" not in one._jdf.queryExecution().optimizedPlan().toString() and one.count() == 5


def test_means_of_contributions_dont_explode_the_lines(spark):
    """Means by feature or tier take a row a line; only the means become a row a feature."""
    from arledger.operators import attribution

    lines = _five_lines(spark)
    phi, _ = attribution.shapley(attribution.linear_scorer([0.3 * (i + 1) for i in range(12)]), lines, attribution.background(lines, n=2), n_samples=3)
    plain = spark.createDataFrame(phi.collect(), phi.schema)
    reports = [attribution.global_importance, lambda p: attribution.contributions_by_tier(p, lines)]
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for report in reports:
        found = report(phi)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")  # the aggregate is below
        assert rows(found) == rows(report(plain)) and found.columns == report(plain).columns
    error = [{r["max_phi_se"] for r in attribution.with_error(reports[0](p), p).collect()} for p in (phi, plain)]
    assert error[0] == error[1] and len(error[0]) == 1
    none, _ = attribution.shapley(attribution.linear_scorer([1.0] * 12), lines.limit(0), attribution.background(lines, n=1), n_samples=2)
    assert attribution.global_importance(none).count() == attribution.contributions_by_tier(none, lines).count() == 0


def test_runs_are_aggregated_by_hash(spark):
    """An aggregate that keeps a string sorts its rows, and none of it is compiled."""
    from arledger.operators import attribution

    lines = _five_lines(spark)
    phi, _ = attribution.shapley(attribution.linear_scorer([1.0] * 12), lines, attribution.background(lines, n=1), n_samples=2)
    found = attribution.interaction_strengths(phi, lines, F.lit("CUST_LATE_RATE"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    names = [r["interaction"] for r in found.collect()]
    assert len(names) == len(FEATURE_COLS) - 1 and "CUST_LATE_RATE" not in names
    top = attribution.top_dependence(phi, lines)
    assert "map(" not in top._jdf.queryExecution().optimizedPlan().toString()  # two values of a line, not a map of all
    want = lines.collect()
    for r in top.collect():
        assert any(r["value"] == w[r["feature"]] and r["interaction_value"] == w[r["interaction"]] for w in want if w["BELNR"] == r["BELNR"])


def test_fit_keeps_only_the_columns_it_reads(inp, monkeypatch):
    from arledger.operators import classify

    seen, frame = [], classify.training_frame
    monkeypatch.setattr(classify, "training_frame", lambda df, *a: seen.append(df.columns) or frame(df, *a))
    train = inp.split.where("split = 'train'").drop("split")
    model = classify.train_classifier(train, classify.ClassifierConfig(n_rounds=2, cv_folds=2), with_cv=True)
    allowed = {"BELNR", "BUZEI", *FEATURE_COLS, "LATE_FLAG", "is_val", "features", "label", "weight", "fold"}
    assert len(seen) == 2 and all(set(c) <= allowed for c in seen) and model.cv_auc > 0.5


def test_more_rounds_at_once_give_the_same_model(inp, monkeypatch):
    """Many rows take several steps of the rounds in one fit: fewer fits, the same trees and the same trace."""
    from arledger.operators import classify

    cfg = classify.ClassifierConfig(n_rounds=24, first_rounds=3, patience=4, max_depth=3)
    fits, gbt = [], classify._gbt
    monkeypatch.setattr(classify, "_gbt", lambda c, rounds=None: fits.append(rounds) or gbt(c, rounds))
    train = inp.split.where("split = 'train'").drop("split")
    cut = classify.fit_columns(classify.validation_cut(train), cfg.features)
    data = classify.assemble(cut).withColumn("weight", F.lit(1.0)).coalesce(1).sortWithinPartitions("BELNR").persist()
    model, trace = classify.fit_boosted(data, cfg)
    apart, fits[:] = list(fits), []
    assert len(apart) > 1 and apart == [3, 6, 12, 24][: len(apart)]
    monkeypatch.setattr(classify, "FIRST_FIT_ROWS", 1)
    again, trace_again = classify.fit_boosted(data, cfg)
    assert fits == [24] and trace_again == trace and again.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:]
    data.unpersist()


def test_partitions_of_a_fit_dont_follow_the_rows():
    """Every task of every level sends its result to the driver: six times the rows aren't six times the tasks."""
    from arledger.operators.classify import fit_partitions

    assert [fit_partitions(n) for n in (0, 1, 100_000, 100_001, 800_000, 2_400_000)] == [1, 1, 1, 2, 8, 24]
    assert fit_partitions(4_800_000) == fit_partitions(28_800_000) == 24
    assert fit_partitions(288_000_000) == 240  # a task's rows stay bounded


def _random_forest(n_trees: int, depth: int, seed: int) -> list[tuple[float, dict]]:
    import random

    rnd = random.Random(seed)

    def grow(nodes, at, level):
        nodes[at] = {"id": at, "leftChild": -1, "rightChild": -1, "split": None, "prediction": rnd.gauss(0, 1)}
        if level < depth and rnd.random() < 0.9:
            nodes[at].update(leftChild=2 * at + 1, rightChild=2 * at + 2,
                             split={"featureIndex": rnd.randrange(12), "leftCategoriesOrThreshold": [rnd.choice([-1.0, 0.0, 0.5, 2.0])], "numCategories": -1})
            grow(nodes, 2 * at + 1, level + 1)
            grow(nodes, 2 * at + 2, level + 1)

    forest = []
    for t in range(n_trees):
        nodes: dict = {}
        grow(nodes, 0, 0)
        forest.append((1.0 / (t + 1), nodes))
    return forest


def _lines(spark, n: int, seed: int):
    import random

    rnd = random.Random(seed)
    value = lambda: rnd.choice([-1.0, 0.0, 0.5, 2.0, rnd.gauss(0, 2), None])
    rows = [(i, rnd.choice([0, 1, 1, None]), *[value() for _ in FEATURE_COLS]) for i in range(n)]
    return spark.createDataFrame(rows, "BELNR long, LATE_FLAG int, " + ", ".join(f"{c} double" for c in FEATURE_COLS)).repartition(3)


def test_leaves_share_their_lookups(spark):
    """Few leaves a look-up instead of one, the same contributions as leaf by leaf."""
    import numpy as np

    forest = _random_forest(4, 6, 5) + [(0.5, {0: {"id": 0, "leftChild": -1, "rightChild": -1, "split": None, "prediction": 0.3}})]
    leaves = attribution.tree_leaves(forest)
    parts, rnd = [], np.random.default_rng(1)
    for _, on, _, _ in leaves:
        parts.append(rnd.normal(size=(len(on), 1 << len(on))))
    lookups = attribution.leaf_lookups(leaves, parts)
    assert len(lookups) <= 0.4 * len(leaves) and all(len(b) <= attribution.LOOKUP_BOUNDS for b, _, _ in lookups)
    for x in rnd.choice([-1.0, 0.0, 0.5, 2.0, 0.2, -3.0, np.inf], size=(50, 12)):
        want, got = np.zeros(13), np.zeros(13)
        for (value, on, lower, upper), part in zip(leaves, parts):
            inside = (x[on] > lower) & (x[on] <= upper)
            want[on] += part[:, int((inside << np.arange(len(on))).sum())]
            want[12] += value if inside.all() else 0.0
        for bounds, on, table in lookups:
            got[[*on, 12]] += table[:, sum(int(x[f] <= b) << k for k, (f, b) in enumerate(bounds))]
        assert np.allclose(want, got, atol=1e-12)


def test_staged_counts_give_the_auc_of_the_margins(spark):
    """Counted in the tasks: no row a line and round, the same AUC of every round."""
    from arledger.operators import classify, metrics

    forest, lines = _random_forest(5, 4, 3), _lines(spark, 400, 4)
    by_row = metrics.staged_auc(classify.staged_margins(lines, forest, ["LATE_FLAG"]))
    counts = classify.staged_counts(lines, forest, "LATE_FLAG")
    assert sorted(metrics.auc_of_counts(counts).collect()) == sorted(by_row.collect())
    assert "Generate" not in metrics.auc_of_counts(counts)._jdf.queryExecution().toString()
    assert counts.groupBy("round").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).select("n").distinct().count() == 1
    none = lines.withColumn("LATE_FLAG", F.lit(None).cast("int"))
    assert sorted(metrics.auc_of_counts(classify.staged_counts(none, forest, "LATE_FLAG")).collect()) == [(k, None) for k in range(1, 6)]
    assert classify.staged_counts(lines.limit(0), forest, "LATE_FLAG").count() == 0
