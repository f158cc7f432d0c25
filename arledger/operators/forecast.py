"""Quantile cash-collection forecasts.

The quantile models are boosted trees on the pinball loss (``boosting``), one per (model, horizon, quantile): the
global model on the overall series (or on the pooled segments) and one per eligible segment value. All of them are
fitted in one job over one table of rows keyed by the model, and kept as one table of leaves. Scoring, of the test
rows as of any selection of slices, is one join with that table; the number of jobs doesn't depend on the
number of segments or selections. Every table here is bounded by slices x months, not by invoice volume.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import (
    FORECAST_FEATURE_COLS,
    FORECAST_HORIZONS,
    FORECAST_QUANTILES,
    SEGMENT_COLUMN,
)
from ..session import stored
from . import boosting
from .monthly import SLICE, horizon_targets, segment_summary, select_slice
from .normalize import normalize_selector


@dataclass
class ForecastConfig:
    boost: boosting.BoostConfig = field(default_factory=boosting.BoostConfig)
    quantiles: tuple = tuple(FORECAST_QUANTILES)
    horizons: tuple = tuple(FORECAST_HORIZONS)


def qname(q: float) -> str:
    """Column name of a quantile prediction: 0.1 -> q10."""
    return f"q{int(round(q * 100)):02d}"


def quantile_columns(rows: DataFrame, trees: DataFrame, keep: list[str], quantiles) -> DataFrame:
    """model, horizon, ``keep`` and one ``qname(q)`` column each."""
    long = boosting.predict(rows, trees, FORECAST_FEATURE_COLS, keep)
    return long.groupBy("model", "horizon", *keep).agg(*[
        F.max(F.when(F.col("quantile") == F.lit(float(q)), F.col("prediction"))).alias(qname(q)) for q in quantiles])


def pinball_table(pred: DataFrame, quantiles, target: str = "TARGET") -> DataFrame:
    """Mean pinball loss per (model, horizon, quantile) in one aggregate."""
    stacked = ", ".join(f"CAST({float(q)} AS DOUBLE), `{qname(q)}`" for q in quantiles)
    long = pred.select("model", "horizon", target, F.expr(f"stack({len(quantiles)}, {stacked}) AS (quantile, pred)"))
    miss = F.col(target) - F.col("pred")
    loss = F.greatest(F.col("quantile") * miss, (F.col("quantile") - 1) * miss)
    return long.groupBy("model", "horizon", "quantile").agg(
        F.bround(F.avg(loss), 2).alias("pinball_loss"), F.count(F.lit(1)).alias("n_test")
    ).select("model", F.concat(F.col("horizon").cast("string"), F.lit("d")).alias("horizon"), "quantile", "pinball_loss", "n_test")


@dataclass
class Forecaster:
    """The global models and those of the eligible segment values."""

    trees: DataFrame  # one row per leaf of every (model, horizon, quantile)
    summary: DataFrame  # M16 + trained flag / reason
    results: DataFrame  # M22 pinball losses
    cfg: ForecastConfig
    segment: str = SEGMENT_COLUMN

    @property
    def models(self) -> set[tuple[str, int]]:
        """(model, horizon) of all fitted models."""
        return {(r["model"], r["horizon"]) for r in self.trees.where("tree = 0").select("model", "horizon").distinct().collect()}

    def rounds(self) -> DataFrame:
        """Kept rounds and leaves of every model, and its loss on the test months."""
        last = F.max(F.struct("tree", "test_loss"))["test_loss"]
        return self.trees.groupBy(*boosting.MODEL).agg(
            F.max("tree").alias("n_rounds"), F.count_if(F.col("tree") > 0).alias("n_leaves"), last.alias("test_loss"))

    def save(self, path: str) -> None:
        """The leaves of all models, the summary, the results and one metadata row (written last)."""
        for name in ("trees", "summary", "results"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        boost = [str(getattr(self.cfg.boost, f.name)) for f in fields(boosting.BoostConfig)]
        meta = [(",".join(map(str, self.cfg.quantiles)), ",".join(map(str, self.cfg.horizons)), ",".join(FORECAST_FEATURE_COLS), self.segment, *boost)]
        names = ["quantiles", "horizons", "feature_cols", "segment", *(f.name for f in fields(boosting.BoostConfig))]
        spark = self.summary.sparkSession
        spark.createDataFrame(meta, ", ".join(f"{n} string" for n in names)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(path: str) -> "Forecaster":
        spark = SparkSession.getActiveSession()
        meta = spark.read.parquet(f"{path}/meta").first()
        boost = boosting.BoostConfig(**{f.name: type(f.default)(meta[f.name]) for f in fields(boosting.BoostConfig)})
        cfg = ForecastConfig(boost, tuple(float(q) for q in meta["quantiles"].split(",")), tuple(int(h) for h in meta["horizons"].split(",")))
        return Forecaster(*[spark.read.parquet(f"{path}/{name}") for name in ("trees", "summary", "results")], cfg, meta["segment"])


#: What tells the rows of a series apart: they are sorted by it before a fit.
ROW = [*SLICE, "COLLECT_MONTH"]


def model_rows(monthly: DataFrame, summary: DataFrame, horizons=tuple(FORECAST_HORIZONS), pooled: bool = False, segment: str = SEGMENT_COLUMN) -> DataFrame:
    """The targets (M13) of every model: those of the overall series for ``global`` (``pooled``: of all kept
    segment series, if there are any) and those of each eligible segment value for ``segment:value``.
    Targets never cross slices (lead inside a slice) and the 80 % split is per slice."""
    targets = horizon_targets(monthly, horizons)
    flag_seg, flag_other = ("ALL_REGION", "ALL_INDUSTRY") if segment == "REGION" else ("ALL_INDUSTRY", "ALL_REGION")
    series = targets.where((F.col(flag_seg) == 0) & (F.col(flag_other) == 1)).join(
        summary.select(F.col("segment").alias(segment), "eligible_for_segment_model", "kept_for_pooling"), segment)
    of_segment = series.where("eligible_for_segment_model").withColumn("model", F.concat(F.lit("segment:"), F.col(segment)))
    overall = targets.where((F.col("ALL_REGION") == 1) & (F.col("ALL_INDUSTRY") == 1)).withColumn("model", F.lit("global"))
    if pooled:
        any_kept = summary.agg(F.coalesce(F.max(F.col("kept_for_pooling")), F.lit(False))).scalar()
        pool = series.where("kept_for_pooling").withColumn("model", F.lit("global"))
        overall = overall.where(~any_kept).select(*targets.columns, "model").unionByName(pool.select(*targets.columns, "model"))
    rows = overall.select(*targets.columns, "model").unionByName(of_segment.select(*targets.columns, "model"))
    return rows.select("model", F.col("HORIZON_DAYS").cast("int").alias("horizon"), (F.col("split") == "train").alias("is_train"),
                       F.col("TARGET").alias("target"), *ROW, *FORECAST_FEATURE_COLS)


def train_forecaster(monthly: DataFrame, cfg: ForecastConfig | None = None, pooled: bool = False,
                     segment: str = SEGMENT_COLUMN) -> Forecaster:
    """M15 + M18 + M22: all models of all horizons and quantiles in one job, kept as one table of leaves; then
    all test rows get all quantiles and losses in one aggregate."""
    cfg = cfg or ForecastConfig()
    summary = segment_summary(monthly, segment)
    rows = stored(model_rows(monthly, summary, cfg.horizons, pooled, segment), "forecast-rows")
    trees = stored(boosting.fit_models(rows, FORECAST_FEATURE_COLS, cfg.quantiles, cfg.boost, tuple(ROW)), "forecast-trees")
    test = rows.where(~F.col("is_train"))
    pred = quantile_columns(test, trees, [*ROW, "target"], cfg.quantiles)
    results = stored(pinball_table(pred, cfg.quantiles, "target"), "forecast-results")
    trained = F.col("eligible_for_segment_model")
    summary = summary.withColumn("trained", trained).withColumn(
        "reason", F.when(trained, F.lit("trained")).otherwise(F.col("reason")))
    return Forecaster(trees, stored(summary, "forecast-summary"), results, cfg, segment)


def selections(spark: SparkSession, slices: list[tuple[str | None, str | None]]) -> DataFrame:
    """N9 for a list of (region, industry) selections: the labels to show and the values to look for (null: all)."""
    rows = [(i, r or "All", s or "All", normalize_selector(r), normalize_selector(s)) for i, (r, s) in enumerate(slices)]
    return spark.createDataFrame(rows, "selection int, Selected_Region string, Selected_Industry string, region string, industry string")


def resolve_models(chosen: DataFrame, summary: DataFrame, segment: str = SEGMENT_COLUMN) -> DataFrame:
    """M19 for all selections at once: the models of the selected segment value if it has them, else the global ones
    (columns model, Model_Source, Model_Segment)."""
    own = summary.where("trained").select(F.col("segment").alias("_trained"))
    value = F.col("region") if segment == "REGION" else F.col("industry")
    found = chosen.join(own, value == F.col("_trained"), "left")
    has = F.col("_trained").isNotNull()
    return found.select(*chosen.columns, F.when(has, F.concat(F.lit("segment:"), value)).otherwise("global").alias("model"),
                        F.when(has, "segment").otherwise("global").alias("Model_Source"), F.coalesce(value, F.lit("All")).alias("Model_Segment"))


def latest_rows(monthly: DataFrame, chosen: DataFrame, min_rows: int = 12) -> DataFrame:
    """M20 for all selections at once: the latest row of the selected slice if it has ``min_rows`` months, else of the
    overall series, and which one it is and why (Inference_Slice)."""
    latest = monthly.withColumns({
        "_months": F.count(F.lit(1)).over(Window.partitionBy(*SLICE)),
        "_rk": F.row_number().over(Window.partitionBy(*SLICE).orderBy(F.desc("COLLECT_MONTH")))}).where("_rk = 1")
    latest = stored(latest.drop("_rk"), "forecast-latest")  # one row per slice
    # flags and values are looked for together, so a slice without a label isn't taken for the overall one
    slices = latest.select((F.col("ALL_REGION") == 1).alias("_all_r"), (F.col("ALL_INDUSTRY") == 1).alias("_all_i"), F.when(F.col("ALL_REGION") == 0, F.col("REGION")).alias("_r"),
                           F.when(F.col("ALL_INDUSTRY") == 0, F.col("INDUSTRY")).alias("_i"), F.struct(*monthly.columns).alias("_row"), F.col("_months"))
    same = F.col("region").eqNullSafe(F.col("_r")) & F.col("industry").eqNullSafe(F.col("_i"))
    flags = (F.col("region").isNull() == F.col("_all_r")) & (F.col("industry").isNull() == F.col("_all_i"))
    found = chosen.join(slices, same & flags, "left")
    months = F.coalesce("_months", F.lit(0))
    whole = F.col("region").isNull() & F.col("industry").isNull()
    portfolio = slices.where("_all_r and _all_i").select(F.col("_row").alias("_overall"))
    overall = portfolio.select("_overall").scalar()
    own = whole | (months >= min_rows)
    why = F.when(whole, F.lit("portfolio")).when(months >= min_rows, F.lit("selected slice")).otherwise(
        F.concat(F.lit("portfolio (fallback: selected slice has "), months.cast("string"), F.lit(f" months < {min_rows})")))
    rows = found.select(*chosen.columns, why.alias("Inference_Slice"), F.when(own, F.col("_row")).otherwise(overall).alias("_row")).where("_row is not null")
    return rows.select(*chosen.columns, "Inference_Slice", "_row.*")


#: Columns that a quantile source hands to ``forecast_table``.
BOUNDS = ["LOWER", "MEDIAN", "UPPER"]


def forecast_table(pred: DataFrame) -> DataFrame:
    """M21 from any quantiles (Horizon_Days, LOWER, MEDIAN, UPPER and the model columns): lower <=
    median <= upper, clipped at 0 and rounded (half-even) to cents; width from the unclipped
    bounds; uncertainty % = width / max(median, 1) * 100 rounded to 1."""
    med = F.col("MEDIAN")
    lower, upper = F.least(F.col("LOWER"), med), F.greatest(F.col("UPPER"), med)
    rest = [c for c in pred.columns if c not in {*BOUNDS, "Horizon_Days"}]
    zero = F.lit(0.0)
    return pred.select(
        F.concat(F.col("Horizon_Days").cast("string"), F.lit(" days")).alias("Horizon"),
        F.col("Horizon_Days").cast("int").alias("Horizon_Days"),
        F.bround(F.greatest(lower, zero), 2).alias("Lower_10pct"),
        F.bround(F.greatest(med, zero), 2).alias("Median_50pct"),
        F.bround(F.greatest(upper, zero), 2).alias("Upper_90pct"),
        F.bround(F.greatest(upper - lower, zero), 2).alias("Range_Width"),
        F.bround(F.greatest((upper - lower) / F.greatest(med, F.lit(1.0)) * 100, zero), 1).alias("Uncertainty_Pct"),
        *rest,
    )


def generate_forecasts(fc: Forecaster, monthly: DataFrame, slices: list[tuple[str | None, str | None]]) -> DataFrame:
    """M21 for several (region, industry) selections at once: their rows and models are joined, and all get all
    quantiles in one sum."""
    qs = fc.cfg.quantiles
    lo_q, med_q, hi_q = (min(qs, key=lambda x: abs(x - t)) for t in (0.10, 0.50, 0.90))
    ids = ["selection", "Selected_Region", "Selected_Industry", "Model_Source", "Model_Segment", "Inference_Slice"]
    chosen = resolve_models(selections(monthly.sparkSession, slices), fc.summary, fc.segment)
    rows = latest_rows(monthly, chosen).withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in fc.cfg.horizons])))
    pred = quantile_columns(rows, fc.trees, ids, [lo_q, med_q, hi_q])
    return forecast_table(pred.select(
        F.col("horizon").alias("Horizon_Days"), F.col(qname(lo_q)).alias("LOWER"), F.col(qname(med_q)).alias("MEDIAN"),
        F.col(qname(hi_q)).alias("UPPER"), *ids[1:]))


def generate_forecast(fc: Forecaster, monthly: DataFrame, region: str | None = None,
                      industry: str | None = None) -> DataFrame:
    """M21 for one selection (see ``generate_forecasts``)."""
    return generate_forecasts(fc, monthly, [(region, industry)]).drop("Selected_Region", "Selected_Industry")


def standin_quantiles(monthly: DataFrame, slices: list[tuple[str | None, str | None]], horizons=tuple(FORECAST_HORIZONS)) -> DataFrame:
    """Model-free quantiles from a slice's own recent months, so the forecast reports have an exact
    oracle. They are neither ordered nor positive, which ``forecast_table`` has to mend."""
    h = F.col("Horizon_Days")
    rows = latest_rows(monthly, selections(monthly.sparkSession, slices))
    return rows.withColumn("Horizon_Days", F.explode(F.array(*[F.lit(int(x)) for x in horizons]))).select(
        "Horizon_Days", (F.col("COLLECTIONS_LAG2") - F.col("COLLECTIONS_ROLL3_MEAN") * h / 45).alias("LOWER"),
        (F.col("COLLECTIONS_LAG1") - F.col("COLLECTIONS_ROLL3_MEAN") * (h - 30) / 80).alias("MEDIAN"),
        (F.col("ACTUAL_COLLECTIONS") * h / 60).alias("UPPER"), "Selected_Region", "Selected_Industry", "Inference_Slice")


def regions(monthly: DataFrame) -> list[str]:
    """The region labels of the series (a closed label list)."""
    rows = monthly.where((F.col("ALL_REGION") == 0) & (F.col("ALL_INDUSTRY") == 1)).select("REGION").distinct().collect()
    return sorted(r["REGION"] for r in rows if r["REGION"] is not None)


def history_band(monthly_slice: DataFrame, n_months: int = 18) -> DataFrame:
    """Last 18 months in millions with a rolling sample std of 3 (min 2); missing std is
    max(0.25 x std of the window, 0.15); lower bound clipped at 0."""
    w_desc = Window.orderBy(F.desc("COLLECT_MONTH"))
    last = monthly_slice.withColumn("_rk", F.row_number().over(w_desc)).where(F.col("_rk") <= n_months)
    m = F.col("ACTUAL_COLLECTIONS") / 1e6
    w = Window.orderBy("COLLECT_MONTH")
    roll = w.rowsBetween(-2, 0)
    band = last.select(
        "COLLECT_MONTH", m.alias("collections_m"),
        F.when(F.count(m).over(roll) >= 2, F.stddev_samp(m).over(roll)).alias("_std"),
        F.stddev_samp(m).over(Window.partitionBy()).alias("_all_std"),
    )
    fallback = F.greatest(F.coalesce(F.col("_all_std") * 0.25, F.lit(0.15)), F.lit(0.15))
    std = F.coalesce(F.col("_std"), fallback)
    return band.select(
        "COLLECT_MONTH", "collections_m", std.alias("band_std"),
        (F.col("collections_m") + std).alias("upper_m"),
        F.greatest(F.col("collections_m") - std, F.lit(0.0)).alias("lower_m"),
    )


def forecast_points(monthly_slice: DataFrame, forecast: DataFrame) -> DataFrame:
    """P10: forecast dates = first day of the last month + horizon days; values in millions."""
    last = monthly_slice.agg(F.max("PERIOD_DT")).scalar()
    return forecast.select(
        "Horizon_Days", F.date_add(last, F.col("Horizon_Days")).alias("forecast_date"),
        (F.col("Median_50pct") / 1e6).alias("median_m"), (F.col("Lower_10pct") / 1e6).alias("lower_m"),
        (F.col("Upper_90pct") / 1e6).alias("upper_m"),
    )


def chart_series(monthly_slice: DataFrame, forecast: DataFrame, n_months: int = 18) -> DataFrame:
    """P10: the whole chart - the last ``n_months`` months of history with their band, then the
    forecast points (series, date, value, lower and upper in millions)."""
    day = F.to_date(F.concat("COLLECT_MONTH", F.lit("-01")))
    past = history_band(monthly_slice, n_months).select(
        F.lit("history").alias("series"), day.alias("date"), F.col("collections_m").alias("value_m"), "lower_m", "upper_m")
    points = forecast_points(monthly_slice, forecast).select(
        F.lit("forecast").alias("series"), F.col("forecast_date").alias("date"), F.col("median_m").alias("value_m"), "lower_m", "upper_m")
    return past.unionByName(points)
