"""Late-payment classifier as MLlib jobs.

* C1 features: ``VectorAssembler`` over the 12 model features.
* C2 validation cut: the last 20 % of the train split by time (same exact cut as F28).
* C3 cross-validation: folds are exactly stratified - a distributed rank over (label, seeded
  hash) and rank mod k - then a fit without each of them, with exact AUC (numBins=0) on it.
* C4 boosted trees: the trees of ``GBTClassifier`` (grown by ``trees``) with a class weight column (positive weight =
  round(neg/pos, 2)), row / feature subsampling. Rounds are stopped with patience on the validation
  AUC: one pass takes every validation row's margin after each tree and counts it by bin, one aggregate of the counts
  gives the AUC of all prefixes of the ensemble, and the ensemble is cut at its best round. A fit that may still improve goes
  on to twice the rounds; many rows, on which the best round comes late, take more rounds at once, with the same answer.
* C5 isotonic regression, or Platt scaling: logistic regression on the tree margin with Platt's smoothed targets,
  expressed as two weighted rows per validation row.
* C6 threshold: ``metrics.optimize_threshold`` on calibrated validation probabilities.
* C8 baselines: stratified random and standardised logistic regression.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from . import trees
from ..constants import CV_FOLDS, FEATURE_COLS, RANDOM_SEED, TARGET_COL, TEST_SIZE
from ..session import tables_dir
from ..sources import models
from .features import build_feature_store, time_split
from .metrics import auc_of_counts, margin_bins, optimize_threshold, ranking_metrics
from .scoring import predict


@dataclass
class ClassifierConfig:
    # at most 500 rounds as in the published model, of which those up to the best validation AUC are
    # kept: the one that the next ``patience`` rounds don't exceed
    n_rounds: int = 500
    patience: int = 50
    first_rounds: int = 150  # of the first fit
    max_depth: int = 6
    step_size: float = 0.05
    subsample: float = 0.8
    feature_subset: str = "0.8"
    min_instances_per_node: int = 5
    calibrate: bool = True
    cv_folds: int = CV_FOLDS
    cv_rounds: int = 0  # 0: as many as the fitted model kept
    cv_parallelism: int = 5
    calibration: str = "sigmoid"  # or "isotonic"
    seed: int = RANDOM_SEED
    features: list[str] = field(default_factory=lambda: list(FEATURE_COLS))


def assemble(df: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """Feature vector + integer label."""
    va = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")
    return va.transform(df.withColumn("label", F.col(TARGET_COL).cast("int")))


def positive_weight(df: DataFrame) -> float:
    """round(neg / pos, 2) from one aggregate (two scalars reach the driver)."""
    row = df.agg(F.count_if(F.col(TARGET_COL) == 0).alias("neg"), F.count_if(F.col(TARGET_COL) == 1).alias("pos")).first()
    return round(row["neg"] / row["pos"], 2) if row["pos"] else 1.0


def validation_cut(train: DataFrame, share: float = TEST_SIZE) -> DataFrame:
    """``is_val`` = the last ``share`` of the train rows by document date."""
    cut = time_split(train, share)
    return cut.withColumn("is_val", F.col("split") == "test").drop("split")


#: Rows of one (class, hash range) group that the fold number is counted in.
FOLD_GROUP_ROWS = 200_000


def stratified_folds(df: DataFrame, k: int, seed: int = RANDOM_SEED) -> DataFrame:
    """fold = (rank inside the class by a seeded hash) mod k - exactly stratified.

    The rank is the number of rows in the lower ranges of the hash plus the row's number in its
    own range. The ranges are fixed by the hash's leading bits, so counts and numbers agree
    whatever the partitioning; a class of any size is spread over its ranges.
    """
    keys = [c for c in ("BELNR", "BUZEI") if c in df.columns]
    keyed = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)))
    n = df.count()
    bits = max(0, (n // FOLD_GROUP_ROWS).bit_length())
    ranged = keyed.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = ranged.groupBy(TARGET_COL, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(TARGET_COL).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    before = counts.select(F.col(TARGET_COL).alias("_t"), F.col("_b").alias("_bb"), (upto - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(TARGET_COL, "_b").orderBy("_h", *keys))
    ranked = ranged.withColumn("_in", inside).join(before, F.col(TARGET_COL).eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_bb")))
    return ranked.withColumn("fold", F.pmod(F.col("_before") + F.col("_in") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")


#: Partitions of a fit's input until they hold FIT_PARTITION_ROWS rows each, and more from there on.
FIT_PARTITIONS, FIT_PARTITION_ROWS = 24, 1_200_000


def fit_partitions(n: int, rows_per_partition: int = 100_000) -> int:
    """A tree learner's two stages a level have a task a partition, and each sends its result (3 KB) to the driver: the
    number of partitions grows with few rows and with very many, not in between."""
    return max(1, min(-(-n // rows_per_partition), FIT_PARTITIONS), -(-n // FIT_PARTITION_ROWS))


def training_frame(df: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """Persisted input for iterative MLlib fits, in ``fit_partitions``, of about ``rows_per_partition``
    rows if these are few: tree learners run several jobs per level, so tiny partitions cost more in scheduling
    than in work. The number of partitions follows the rows alone, and rows are dealt by their
    key's hash, so the model doesn't depend on the number of cores."""
    n = df.count()
    keys = [c for c in ("BELNR", "BUZEI") if c in df.columns]
    shaped = df.repartition(fit_partitions(n, rows_per_partition), *keys).sortWithinPartitions(*keys) if keys else df
    shaped = shaped.persist()
    shaped.count()
    return shaped


def fit_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """Only what a fit reads (keys, features, label): its input is shuffled, sorted and kept in memory several times."""
    need = {"BELNR", "BUZEI", *features, TARGET_COL, "is_val"}
    return df.select(*[c for c in df.columns if c in need])


def _gbt(cfg: ClassifierConfig, rounds: int | None = None) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds or cfg.n_rounds,
        maxDepth=cfg.max_depth, stepSize=cfg.step_size, subsamplingRate=cfg.subsample,
        featureSubsetStrategy=cfg.feature_subset, minInstancesPerNode=cfg.min_instances_per_node,
        seed=cfg.seed, lossType="logistic",
    )


def tree_nodes(gbt: GBTClassificationModel, spark: SparkSession) -> list[tuple[float, dict]]:
    """(weight, nodes by id) of every tree, read from the saved model (at most 500 x 127 nodes)."""
    path = f"{tables_dir(spark)}/trees-{uuid.uuid4().hex[:12]}"
    gbt.write().save(path)
    trees: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        if r["split"]["numCategories"] != -1 and r["leftChild"] >= 0:
            raise ValueError("splits by category aren't supported")
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return [(w, trees[i]) for i, w in enumerate(gbt.treeWeights)]


#: A tree as arrays by node: depth, feature, cut, left, right (a leaf's children are itself), value.
_Walk = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _walks(trees: list[tuple[float, dict]]) -> list[_Walk]:
    flat = []
    for weight, nodes in trees:
        ids = sorted(nodes)
        at = {i: k for k, i in enumerate(ids)}
        inner = [nodes[i]["leftChild"] >= 0 for i in ids]
        cell = lambda f, none, nodes=nodes, ids=ids, inner=inner: np.array([f(nodes[i]) if inner[k] else none(k) for k, i in enumerate(ids)])
        depth, level = 0, [0]
        while level := [c for i in level if nodes[i]["leftChild"] >= 0 for c in (nodes[i]["leftChild"], nodes[i]["rightChild"])]:
            depth += 1
        flat.append((depth, cell(lambda r: r["split"]["featureIndex"], lambda k: 0), cell(lambda r: r["split"]["leftCategoriesOrThreshold"][0], lambda k: 0.0),
                     cell(lambda r, at=at: at[r["leftChild"]], lambda k: k), cell(lambda r, at=at: at[r["rightChild"]], lambda k: k),
                     2 * weight * np.array([nodes[i]["prediction"] for i in ids])))
    return flat


def _margins(batch: pa.RecordBatch, first: int, n_feat: int, flat: list[_Walk]):
    """The margins of a batch's rows after each tree, one column after the other; features from column ``first`` on."""
    x = np.stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n_feat)], axis=1).ravel()
    row = np.arange(batch.num_rows) * n_feat
    total = np.zeros(batch.num_rows)
    for depth, feature, cut, left, right, value in flat:
        node = np.zeros(batch.num_rows, np.int64)
        for _ in range(depth):
            node = np.where(x.take(row + feature.take(node)) <= cut.take(node), left.take(node), right.take(node))
        total = total + value.take(node)
        yield total


def staged_margins(rows: DataFrame, trees: list[tuple[float, dict]], keep: list[str], features: list[str] = FEATURE_COLS) -> DataFrame:
    """The columns ``keep`` and MARGINS, a row's log-odds after each tree. Narrow; all rows of a batch go down a
    tree together."""
    flat = _walks(trees)
    source = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            margins = np.empty((n, len(flat)))
            for t, total in enumerate(_margins(batch, len(keep), len(features), flat)):
                margins[:, t] = total
            lists = pa.ListArray.from_arrays(np.arange(0, n * len(flat) + 1, len(flat), dtype=np.int32), margins.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, "MARGINS"])

    return source.mapInArrow(run, f"{kinds}, MARGINS array<double>")


def staged_counts(rows: DataFrame, trees: list[tuple[float, dict]], y: str, features: list[str] = FEATURE_COLS) -> DataFrame:
    """For ``metrics.auc_of_counts``: a task's rows by round, bin of the margin and label, counted in the task, so that no row
    a line and round is made. A task keeps 256 KB a round (128 MB at 500)."""
    flat = _walks(trees)
    low = int(margin_bins(np.array([-np.inf]))[0])
    width = int(margin_bins(np.array([np.inf]))[0]) - low + 1
    source = rows.select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])

    def run(batches):
        counts = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if counts is None:
                counts = np.zeros((len(flat), 2 * width), np.int32)
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            known = (label == 0) | (label == 1)
            late = label[known].astype(np.int64)
            for t, total in enumerate(_margins(batch, 1, len(features), flat)):
                counts[t] += np.bincount(2 * (margin_bins(total[known]) - low) + late, minlength=2 * width)
        for t in range(0 if counts is None else len(flat)):
            of = counts[t].reshape(width, 2).astype(np.int64)
            at = np.flatnonzero(of.any(axis=1))
            at = at if len(at) else np.zeros(1, np.int64)  # rows without a label: a round all the same
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t + 1, np.int32)), pa.array(at + low), pa.array(of[at, 1]), pa.array(of[at, 0])],
                                             ["round", "s", "pos", "neg"])

    return source.mapInArrow(run, "round int, s long, pos long, neg long")


def best_round(trace: list[tuple[int, float | None]], patience: int) -> tuple[int, bool]:
    """The round of the best AUC before ``patience`` rounds in a row don't exceed it (ties: the first), and
    whether the trace is long enough to tell. Without any AUC (one label only) it is the last round."""
    best, at = None, 0
    for k, auc in trace:
        if auc is not None and (best is None or auc > best):
            best, at = auc, k
        elif best is not None and k - at >= patience:
            return at, True
    return (at, False) if best is not None else (trace[-1][0], True)


def first_trees(gbt: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first ``rounds`` trees."""
    java, jvm = gbt._java_obj, SparkContext._active_spark_context._jvm
    trees, weights = java.trees(), java.treeWeights()
    gateway = SparkContext._active_spark_context._gateway
    some = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    of = gateway.new_array(jvm.double, rounds)
    for i in range(rounds):
        some[i], of[i] = trees[i], weights[i]
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), some, of, java.numFeatures(), java.numClasses())
    model = GBTClassificationModel(cut.copy(java.extractParamMap()))
    model._transfer_params_from_java()
    return model


#: Rows that a first fit of ``first_rounds`` is meant for. The best round comes later on more rows, which take more rounds at once.
FIRST_FIT_ROWS = 4_000_000


def fit_boosted(data: DataFrame, cfg: ClassifierConfig) -> tuple[GBTClassificationModel, list[tuple[int, float | None]]]:
    """C4: the ensemble up to its best round, and the validation AUC of every round up to the step (``first_rounds``, doubled
    up to ``n_rounds``) that settles it. How many steps a fit takes at once changes its time, not these.
    ``data``: assembled rows with label, weight and is_val."""
    fit_rows, val = data.where(~F.col("is_val")), data.where(F.col("is_val"))
    steps = [min(cfg.n_rounds, max(1, cfg.first_rounds))]
    while steps[-1] < cfg.n_rounds:
        steps.append(min(cfg.n_rounds, 2 * steps[-1]))
    aim = steps[0] * (1 + data.count() // FIRST_FIT_ROWS)
    rounds = next((s for s in steps if s >= aim), steps[-1])
    fit = None
    while True:
        est = _gbt(cfg, rounds)
        fit = fit or trees.Fit(est, fit_rows, cfg.features)
        gbt = fit.go_on(est)
        spark = data.sparkSession
        counts = staged_counts(val, tree_nodes(gbt, spark), "label", cfg.features)
        trace = [(r["round"], r["auc_roc"]) for r in auc_of_counts(counts).orderBy("round").collect()]  # one row a round
        trace = trace or [(k, None) for k in range(1, gbt.getNumTrees + 1)]
        for step in (s for s in steps if s <= rounds):
            best, settled = best_round(trace[:step], cfg.patience)
            if settled or step >= cfg.n_rounds or gbt.getNumTrees < step:
                return first_trees(gbt, best), trace[:step]
        rounds = steps[steps.index(rounds) + 1]


def cross_validate(fit_rows: DataFrame, cfg: ClassifierConfig) -> float:
    """Mean exact AUC over stratified folds of the fitting rows. Each fold's fit has the same
    number of rounds, ``cv_rounds`` (folds have no validation rows to stop on), or all."""
    fit_rows = fit_columns(fit_rows, [*FEATURE_COLS, *cfg.features])
    spw = positive_weight(fit_rows)
    data = training_frame(assemble(stratified_folds(fit_rows, cfg.cv_folds, cfg.seed)).withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(spw)).otherwise(F.lit(1.0))
    ))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0)

    def of_fold(k: int) -> float:
        est = _gbt(cfg, rounds=cfg.cv_rounds)
        return evaluator.evaluate(trees.Fit(est, data.where(F.col("fold") != k), cfg.features).go_on(est).transform(data.where(F.col("fold") == k)))

    # folds of few rows are a task each, those of many take all tasks one after the other
    with ThreadPoolExecutor(cfg.cv_parallelism if data.count() <= trees.TASK_ROWS else 1) as pool:
        auc = float(np.mean(list(pool.map(inheritable_thread_target(data.sparkSession)(of_fold), range(cfg.cv_folds)))))
    data.unpersist()
    return auc


def margin(df: DataFrame) -> DataFrame:
    """Tree-ensemble log-odds: MLlib's logistic GBT gives p = 1 / (1 + exp(-2F))."""
    return df.withColumn("MARGIN", 2 * vector_to_array("rawPrediction")[1])


def platt(val_scored: DataFrame) -> LogisticRegressionModel:
    """Sigmoid on the margin fitted with Platt's targets (N+ + 1)/(N+ + 2), 1/(N- + 2)."""
    counts = val_scored.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    hi = (counts["p"] + 1.0) / (counts["p"] + 2.0)
    lo = 1.0 / (counts["n"] + 2.0)
    t = F.when(F.col("label") == 1, F.lit(hi)).otherwise(F.lit(lo))
    rows = val_scored.select(F.array(F.col("MARGIN")).alias("_m"), t.alias("_t"))
    two = rows.select(
        "_m", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")),
                                F.struct(F.lit(0.0).alias("y"), (1 - F.col("_t")).alias("w")))).alias("_r")
    ).select(F.col("_r.y").alias("label"), F.col("_r.w").alias("weight"), "_m")
    va = VectorAssembler(inputCols=["_m0"], outputCol="mfeat")
    data = va.transform(two.withColumn("_m0", F.col("_m")[0]))
    lr = LogisticRegression(featuresCol="mfeat", labelCol="label", weightCol="weight", regParam=0.0,
                            standardization=False, maxIter=100)
    return lr.fit(data)


def isotonic(val_scored: DataFrame) -> IsotonicRegressionModel:
    """C5, the other method: a monotone step function of the margin (pool adjacent violators)."""
    rows = val_scored.select(F.col("label").cast("double").alias("label"), F.col("MARGIN").alias("mfeat"))
    return IsotonicRegression(featuresCol="mfeat", labelCol="label", isotonic=True).fit(rows)


@dataclass
class TrainedClassifier:
    gbt: GBTClassificationModel
    calibrator: LogisticRegressionModel | IsotonicRegressionModel | None
    threshold: float
    cv_auc: float | None
    positive_weight: float
    config: ClassifierConfig
    trace: list[tuple[int, float | None]] = field(default_factory=list)  # validation AUC by round

    def trace_table(self) -> DataFrame:
        """C4: (round, auc_roc, kept) of every round that was fitted."""
        rows = [(k, auc, k <= self.gbt.getNumTrees) for k, auc in self.trace]
        return SparkSession.getActiveSession().createDataFrame(rows, "round int, auc_roc double, kept boolean")

    def raw_probability(self, df: DataFrame, out: str = "RAW_PROB") -> DataFrame:
        """Positive-class probability (calibrated when a calibrator exists) + MARGIN."""
        scored = margin(self.gbt.transform(assemble(df, self.config.features)))
        if self.calibrator is None:
            prob = vector_to_array("probability")[1]
        elif isinstance(self.calibrator, IsotonicRegressionModel):
            scored = self.calibrator.setFeaturesCol("MARGIN").setPredictionCol("_iso").transform(scored)
            prob = F.least(F.greatest(F.col("_iso"), F.lit(0.0)), F.lit(1.0))
        else:
            coef = float(self.calibrator.coefficients[0])
            icpt = float(self.calibrator.intercept)
            prob = 1.0 / (1.0 + F.exp(-(F.lit(coef) * F.col("MARGIN") + F.lit(icpt))))
        keep = [c for c in df.columns]
        return scored.select(*keep, "MARGIN", prob.alias(out))

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """C7 with the fitted model: LATE_PROB, LATE_PRED, RISK_LABEL."""
        return predict(self.raw_probability(df), self.threshold if threshold is None else threshold).drop("MARGIN")

    def save(self, path: str) -> None:
        """Model, calibrator and one-row metadata table."""
        self.gbt.write().overwrite().save(f"{path}/gbt")
        self.trace_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/trace")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        self.save_meta(path)

    def save_meta(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        meta = {"threshold": self.threshold, "cv_auc": self.cv_auc, "positive_weight": self.positive_weight,
                "is_calibrated": self.calibrator is not None, "features": ",".join(self.config.features),
                **{k: str(v) for k, v in asdict(self.config).items() if k != "features"}}
        meta = {k: (None if v is None else str(v)) for k, v in meta.items()}
        schema = ", ".join(f"{k} string" for k in meta)
        spark.createDataFrame([tuple(meta.values())], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    def publish(self, path: str, codes: DataFrame) -> None:
        """Save the model with the category codes (F21) that its features were made with, then its manifest."""
        self.save(path)
        models.save_codes(codes, path)
        models.publish(SparkSession.getActiveSession(), path, {
            "kind": "classifier", "model": "gbt", "calibrator": "calibrator" if self.calibrator is not None else "", "trace": "trace", "codes": models.CODES,
            "threshold": repr(self.threshold), "features": ",".join(self.config.features)})

    @staticmethod
    def load_published(folder: str) -> "tuple[TrainedClassifier, DataFrame]":
        """The newest complete version in a folder, and its category codes."""
        spark = SparkSession.getActiveSession()
        found = models.latest(spark, folder)
        if found is None:
            raise FileNotFoundError(f"no published model in {folder}")
        return TrainedClassifier.load(found[0]), models.load_codes(spark, found[0])

    @staticmethod
    def load(path: str) -> "TrainedClassifier":
        """The saved model with its whole configuration."""
        spark = SparkSession.getActiveSession()
        meta = spark.read.parquet(f"{path}/meta").first().asDict()
        kinds = {f.name: type(f.default) for f in fields(ClassifierConfig) if f.name != "features"}
        read = {bool: lambda v: v == "True"}
        cfg = ClassifierConfig(features=meta["features"].split(","),
                               **{k: read.get(t, t)(meta[k]) for k, t in kinds.items() if meta.get(k) is not None})
        kind = IsotonicRegressionModel if cfg.calibration == "isotonic" else LogisticRegressionModel
        cal = kind.load(f"{path}/calibrator") if meta["is_calibrated"] == "True" else None
        cv = None if meta["cv_auc"] is None else float(meta["cv_auc"])
        trace = [(r["round"], r["auc_roc"]) for r in spark.read.parquet(f"{path}/trace").orderBy("round").collect()]
        return TrainedClassifier(GBTClassificationModel.load(f"{path}/gbt"), cal, float(meta["threshold"]),
                                 cv, float(meta["positive_weight"]), cfg, trace)


def train_classifier(train: DataFrame, cfg: ClassifierConfig | None = None, with_cv: bool = False) -> TrainedClassifier:
    """C2-C6 on the train split: validation cut, weighted GBT with patience on the validation AUC, optional CV on the
    fitting rows (with as many rounds as the GBT kept), Platt calibration and the guarded F1 threshold."""
    cfg = cfg or ClassifierConfig()
    cut = fit_columns(validation_cut(train), cfg.features).persist()  # reused by the fit, calibration and threshold steps
    fit_rows = cut.where(~F.col("is_val"))
    spw = positive_weight(fit_rows)
    data = training_frame(assemble(cut, cfg.features).withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(spw)).otherwise(F.lit(1.0))
    ))
    gbt, trace = fit_boosted(data, cfg)
    data.unpersist()
    cv_auc = cross_validate(fit_rows.drop("is_val"), replace(cfg, cv_rounds=cfg.cv_rounds or gbt.getNumTrees)) if with_cv else None
    val = margin(gbt.transform(assemble(cut.where(F.col("is_val")), cfg.features)))
    calibrator = (isotonic(val) if cfg.calibration == "isotonic" else platt(val)) if cfg.calibrate else None
    model = TrainedClassifier(gbt, calibrator, 0.5, cv_auc, spw, cfg, trace)
    val_prob = model.raw_probability(cut.where(F.col("is_val")))
    best = optimize_threshold(val_prob, p="RAW_PROB").first()
    model.threshold = float(best["threshold"]) if best is not None else 0.5
    cut.unpersist()
    return model


def score_invoices(model: TrainedClassifier, codes: DataFrame, customers: DataFrame, invoices: DataFrame, gl: DataFrame) -> DataFrame:
    """C7 for invoices that a model hasn't seen: their features with the codes of its training data, then its scores."""
    return model.predict(build_feature_store(customers, invoices, gl, codes=codes))


def key_uniform(df: DataFrame, seed: int) -> Column:
    """A uniform number in [0, 1) from the row's key, the same whatever the partitioning."""
    keys = [F.col(c).cast("string") for c in ("BELNR", "BUZEI") if c in df.columns]
    digest = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def baselines(train: DataFrame, test: DataFrame, model: TrainedClassifier, seed: int = RANDOM_SEED) -> DataFrame:
    """Test AUC of a stratified random guess, a standardised logistic regression and the
    boosted trees."""
    base_rate = train.agg(F.avg(TARGET_COL)).scalar()
    rnd = test.withColumn("RAW_PROB", (key_uniform(test, seed) < base_rate).cast("double"))
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURE_COLS, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=600),
    ])
    lr_model: PipelineModel = pipe.fit(train.withColumn("label", F.col(TARGET_COL).cast("int")))
    lr_scored = lr_model.transform(test.withColumn("label", F.col(TARGET_COL).cast("int"))).withColumn(
        "RAW_PROB", vector_to_array("probability")[1]
    )
    gbt_scored = model.raw_probability(test)
    parts = [("Random", rnd), ("Logistic", lr_scored), ("BoostedTrees", gbt_scored)]
    out = None
    for name, df in parts:
        m = ranking_metrics(df, p="RAW_PROB").select(F.lit(name).alias("model"), "auc_roc")
        out = m if out is None else out.unionByName(m)
    return out


def class_weight_hint(split_df: DataFrame) -> DataFrame:
    """Rows, late count, late share and round((1 - p) / p, 1) per split."""
    agg = split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(TARGET_COL).cast("long").alias("n_late"),
        F.avg(TARGET_COL).alias("late_share"),
    )
    return agg.withColumn("scale_pos_weight", F.bround((1 - F.col("late_share")) / F.col("late_share"), 1))

