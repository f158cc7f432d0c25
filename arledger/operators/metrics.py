"""Classifier and forecast evaluation as relational jobs.

Rows are first aggregated to one row per distinct score (scores grouped at 1e-6, which bounds
that table at 10^6 rows whatever the volume; probabilities stored at 4 decimals are exact, raw ones
that differ by less than that count as ties),
then cumulative windows run on that small table. Threshold grids are pre-bucketed per row
(number of grid points <= score), so no row-by-grid join is ever formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    MAX_FLAG_RATE_CAP,
    MAX_FLAG_RATE_FALLBACK,
    MAX_FLAG_RATE_MARGIN,
    SENSITIVITY_GRID_START,
    SENSITIVITY_GRID_STOP,
    THRESHOLD_GRID_START,
    THRESHOLD_GRID_STEP,
    THRESHOLD_GRID_STOP,
)

SCORE_DIGITS = 6


def threshold_grid() -> list[float]:
    """C6 grid: the same float sequence as ``arange(.2, .8, .01)`` (61 points)."""
    return [float(x) for x in np.arange(THRESHOLD_GRID_START, THRESHOLD_GRID_STOP, THRESHOLD_GRID_STEP)]


def sensitivity_grid() -> list[float]:
    """E10 grid: ``arange(.1, .9, .01)`` (80 points)."""
    return [float(x) for x in np.arange(SENSITIVITY_GRID_START, SENSITIVITY_GRID_STOP, THRESHOLD_GRID_STEP)]


def calibration_edges(n_bins: int = 10) -> list[float]:
    """Inner edges of ``linspace(0, 1, n_bins + 1)`` (exact floats, right-closed bins)."""
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]


def _count_le(values: list[float], x: Column, strict: bool = False) -> Column:
    """How many of an evenly spaced, rising grid are <= x (< x if strict). The place in the grid is
    computed and then settled by comparing x with the three grid values next to it, so the count
    is exact without walking the grid for every row."""
    step = (values[-1] - values[0]) / (len(values) - 1)
    if max(abs(v - (values[0] + i * step)) for i, v in enumerate(values)) > step / 2:
        raise ValueError("the grid isn't evenly spaced")
    grid = F.array(*[F.lit(v) for v in values])
    guess = F.floor((x - F.lit(values[0])) / F.lit(step)).cast("int") + 1
    c = F.greatest(F.lit(1), F.least(F.lit(len(values)), guess))
    near = [F.get(grid, c + i) for i in (-1, 0, 1)]
    return c - 1 + sum((F.coalesce((v < x) if strict else (v <= x), F.lit(False)).cast("int") for v in near), F.lit(0))


def _ranking_parts(df: DataFrame, y: str, p: str, groups: list[str]) -> DataFrame:
    g = [F.col(c) for c in groups]
    st = df.groupBy(*g, F.bround(F.col(p), SCORE_DIGITS).alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    w = Window.partitionBy(*g).orderBy("s")
    return st.select(
        *g, "s", "pos", "neg",
        F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("neg_below"),
        F.sum("pos").over(Window.partitionBy(*g)).alias("P"),
        F.sum("neg").over(Window.partitionBy(*g)).alias("N"),
        F.sum("pos").over(Window.partitionBy(*g).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)).alias("tp"),
        F.sum("neg").over(Window.partitionBy(*g).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)).alias("fp"),
    )


def auc_expr() -> Column:
    """Mann-Whitney AUC with ties counted half, from ranking parts (aggregate expression)."""
    num = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    return F.when((F.first("P") > 0) & (F.first("N") > 0), num / (F.first("P") * F.first("N")))


def ap_expr() -> Column:
    """Step average precision: sum over distinct scores of (pos / P) * precision@score."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return F.when(F.first("P") > 0, F.sum(F.col("pos") * prec) / F.first("P"))


def ranking_metrics(df: DataFrame, y: str = "LATE_FLAG", p: str = "LATE_PROB", groups: list[str] | None = None) -> DataFrame:
    """E1 AUC-ROC, E2 AUC-PR (step), plus E3 Brier from the rows."""
    groups = list(groups or [])
    parts = _ranking_parts(df, y, p, groups)
    rank = parts.groupBy(*groups).agg(auc_expr().alias("auc_roc"), ap_expr().alias("auc_pr"))
    brier = df.groupBy(*groups).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    return rank.join(brier, groups) if groups else rank.select(
        "auc_roc", "auc_pr", brier.select("brier").scalar().alias("brier")
    )


#: Width of a margin's bin, and the margins (log-odds) beyond which all are in the last bin.
MARGIN_BIN, MARGIN_END = 1e-3, 16.0


def staged_auc(df: DataFrame, y: str = "LATE_FLAG", margins: str = "MARGINS") -> DataFrame:
    """C4: (round, auc_roc) of all prefixes of an ensemble at once, from rows with their margin after every
    round. Rows are counted by (round, bin of the margin, label) before anything is shuffled, so at most
    32,000 rows a round are left for the running sums; margins of one bin count as ties."""
    long = df.select(F.col(y).alias("_y"), F.posexplode(margins).alias("_k", "_m"))
    place = F.floor(F.least(F.greatest(F.col("_m"), F.lit(-MARGIN_END)), F.lit(MARGIN_END)) / F.lit(MARGIN_BIN))
    return _auc_of_bins(long.groupBy((F.col("_k") + 1).alias("round"), place.alias("s")).agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")))


def margin_bins(m: np.ndarray) -> np.ndarray:
    """The bins of ``staged_auc`` for a column of margins."""
    return np.floor(np.fmin(np.maximum(m, -MARGIN_END), MARGIN_END) / MARGIN_BIN).astype(np.int64)


def auc_of_counts(counts: DataFrame) -> DataFrame:
    """``staged_auc`` from counts (round, s: bin, pos, neg) that were made task by task."""
    return _auc_of_bins(counts.groupBy("round", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _auc_of_bins(parts: DataFrame) -> DataFrame:
    below = F.sum("neg").over(Window.partitionBy("round").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("neg_below", F.coalesce(below, F.lit(0)))
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    both = F.sum("pos") * F.sum("neg")
    return parts.groupBy("round").agg(F.when(both > 0, pairs / both).alias("auc_roc"))


def confusion(df: DataFrame, y: str = "LATE_FLAG", pred: str = "LATE_PRED") -> DataFrame:
    """E5: tn, fp, fn, tp."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.agg(
        F.count_if(~yy & ~pp).alias("tn"),
        F.count_if(~yy & pp).alias("fp"),
        F.count_if(yy & ~pp).alias("fn"),
        F.count_if(yy & pp).alias("tp"),
    )


def classification_report(df: DataFrame, y: str = "LATE_FLAG", pred: str = "LATE_PRED") -> DataFrame:
    """Precision, recall, F1, support per class, accuracy, macro and weighted averages
    (zero division gives 0)."""
    c = confusion(df, y, pred)

    def prf(tp, fp, fn):
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
        return prec, rec, f1

    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = F.array(
        F.struct(F.lit("On time").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1_score"), s0.alias("support")),
        F.struct(F.lit("Late").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1_score"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), ((tp + tn) / n).alias("f1_score"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1_score"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f0 * s0 + f1 * s1) / n).alias("f1_score"), n.alias("support")),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


def roc_points(df: DataFrame, y: str = "LATE_FLAG", p: str = "LATE_PROB") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (no intermediate-point dropping)."""
    parts = _ranking_parts(df, y, p, [])
    return parts.select(
        F.col("s").alias("threshold"),
        F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"),
    )


def pr_points(df: DataFrame, y: str = "LATE_FLAG", p: str = "LATE_PROB") -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    parts = _ranking_parts(df, y, p, [])
    return parts.select(
        F.col("s").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("recall"),
    )


def calibration_curve(df: DataFrame, y: str = "LATE_FLAG", p: str = "LATE_PROB", n_bins: int = 10) -> DataFrame:
    """10 equal right-closed bins on [0, 1]; empty bins absent."""
    b = _count_le(calibration_edges(n_bins), F.col(p), strict=True)
    return df.groupBy(b.alias("bin")).agg(
        F.avg(F.col(p)).alias("prob_pred"), F.avg(F.col(y)).alias("prob_true"), F.count(F.lit(1)).alias("n")
    )


def equal_width_bins(x: Column, lo: Column, hi: Column, n_bins: int) -> tuple[Column, Column, Column]:
    """Histogram bin index with numpy's rules: [lo, hi] in n equal bins, last bin closed; a
    zero-width range is widened to [lo - .5, hi + .5]. Returns (bin, left edge, width)."""
    first = F.when(lo == hi, lo - 0.5).otherwise(lo)
    last = F.when(lo == hi, hi + 0.5).otherwise(hi)
    norm = F.lit(float(n_bins)) / (last - first)
    idx = F.floor((x - first) * norm).cast("int")
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(n_bins - 1))
    width = (last - first) / n_bins
    return idx, first + idx * width, width


def class_histogram(df: DataFrame, y: str = "LATE_FLAG", p: str = "LATE_PROB", n_bins: int = 40) -> DataFrame:
    """Per class, n_bins equal bins over the class's own range; density = n / (N * width)."""
    w = Window.partitionBy(y)
    ranged = df.select(
        F.col(y).alias("label"), F.col(p).alias("x"),
    ).where(F.col("x").isNotNull())
    stats = ranged.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("N"))
    j = ranged.join(F.broadcast(stats), "label")  # one row per class
    idx, left, width = equal_width_bins(F.col("x"), F.col("lo"), F.col("hi"), n_bins)
    return j.groupBy("label", idx.alias("bin")).agg(
        F.first(left).alias("bin_left"),
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / (F.first("N") * F.first(width))).alias("density"),
    )


def grid_metrics(df: DataFrame, grid: list[float], y: str = "LATE_FLAG", p: str = "LATE_PROB") -> DataFrame:
    """Precision, recall, F1, flag rate of ``p >= t`` for every grid threshold t.

    Each row is bucketed by how many grid points are <= its score (flagged at grid point k iff
    that count > k); the per-bucket counts are a table of len(grid)+1 rows whose suffix sums give
    the confusion counts of every threshold.
    """
    spark = df.sparkSession
    g = _count_le(grid, F.col(p))
    buckets = df.groupBy(g.alias("g")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    grid_df = spark.createDataFrame(
        [(k + 1, k, float(t)) for k, t in enumerate(grid)],
        T.StructType([T.StructField("g", T.IntegerType()), T.StructField("k", T.IntegerType()),
                      T.StructField("threshold", T.DoubleType())]),
    )
    # both sides have at most len(grid)+1 rows; the outer join keeps the never-flagged bucket 0
    full = grid_df.join(buckets, "g", "full_outer").fillna(0, ["pos", "neg"])
    everything = Window.partitionBy()
    suffix = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    m = full.select(
        "k", "threshold",
        F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
        F.sum("pos").over(everything).alias("P"), F.sum("neg").over(everything).alias("N"),
    ).where(F.col("k").isNotNull())
    P, N = F.col("P"), F.col("N")
    flagged = F.col("tp") + F.col("fp")
    return m.select(
        "k",
        "threshold",
        F.when(flagged > 0, F.col("tp") / flagged).otherwise(0.0).alias("precision"),
        F.when(P > 0, F.col("tp") / P).otherwise(0.0).alias("recall"),
        F.when(flagged + P > 0, 2 * F.col("tp") / (flagged + P)).otherwise(0.0).alias("f1"),
        (flagged / (P + N)).alias("flag_rate"),
        (P / (P + N)).alias("base_rate"),
    )


def optimize_threshold(df: DataFrame, y: str = "LATE_FLAG", p: str = "LATE_PROB") -> DataFrame:
    """Max F1 over the 61-point grid subject to flag rate <= min(.85, base + .10), else
    <= .95, else any; first (lowest) threshold on ties. One row."""
    m = grid_metrics(df, threshold_grid(), y, p)
    cap = F.least(F.lit(MAX_FLAG_RATE_CAP), F.col("base_rate") + F.lit(MAX_FLAG_RATE_MARGIN))
    level = F.when(F.col("flag_rate") <= cap, 0).when(F.col("flag_rate") <= MAX_FLAG_RATE_FALLBACK, 1).otherwise(2)
    m = m.withColumn("_lvl", level)
    best_level = F.min("_lvl").over(Window.partitionBy())
    cand = m.withColumn("_best", best_level).where(F.col("_lvl") <= F.col("_best"))
    rank = F.row_number().over(Window.orderBy(F.desc("f1"), F.asc("k")))
    return (
        cand.withColumn("_r", rank)
        .where(F.col("_r") == 1)
        .select("threshold", "f1", "precision", "recall", "flag_rate", "base_rate",
                cap.alias("max_flag_rate"))
    )


def segment_analysis(df: DataFrame, segments=("INDUSTRY", "REGION"), y: str = "LATE_FLAG",
                     p: str = "LATE_PROB", pred: str = "LATE_PRED", min_n: int = 10) -> DataFrame:
    """Per segment value with n >= 10: n, late share, AUC on the (rounded) probability
    (NULL when one class only), flagged share. Segments unpivoted with ``stack``."""
    pairs = ", ".join(f"'{s}', CAST(`{s}` AS STRING)" for s in segments)
    long = df.select(
        F.expr(f"stack({len(segments)}, {pairs}) AS (segment, value)"), F.col(y).alias("_y"),
        F.col(p).alias("_p"), F.col(pred).alias("_pred"),
    ).where(F.col("value").isNotNull())
    parts = _ranking_parts(long, "_y", "_p", ["segment", "value"])
    auc = parts.groupBy("segment", "value").agg(auc_expr().alias("auc_roc"))
    base = long.groupBy("segment", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("late_share"), F.avg("_pred").alias("flagged_share")
    )
    return base.where(F.col("n") >= min_n).join(auc, ["segment", "value"], "left")


def business_impact(df: DataFrame, y: str = "LATE_FLAG", pred: str = "LATE_PRED", amount: str = "DMBTR") -> DataFrame:
    """Total AR, flagged AR, missed-late AR and their shares (of max(total, 1))."""
    a = F.col(amount)
    agg = df.agg(
        F.coalesce(F.sum(a), F.lit(0.0)).alias("total_ar"),
        F.coalesce(F.sum(F.when(F.col(pred) == 1, a)), F.lit(0.0)).alias("flagged_ar"),
        F.coalesce(F.sum(F.when((F.col(y) == 1) & (F.col(pred) == 0), a)), F.lit(0.0)).alias("missed_ar"),
    )
    d = F.greatest(F.col("total_ar"), F.lit(1.0))
    return agg.select(
        "total_ar", "flagged_ar", (F.col("flagged_ar") / d).alias("flagged_share"),
        "missed_ar", (F.col("missed_ar") / d).alias("missed_share"),
    )


def pinball_loss(df: DataFrame, y: str, yhat: str, q: float | Column, groups: list[str] | None = None) -> DataFrame:
    """Mean quantile loss."""
    qc = q if isinstance(q, Column) else F.lit(float(q))
    e = F.col(y) - F.col(yhat)
    loss = F.when(e >= 0, qc * e).otherwise((qc - 1) * e)
    return df.groupBy(*(groups or [])).agg(F.avg(loss).alias("pinball_loss"), F.count(F.lit(1)).alias("n_test"))
