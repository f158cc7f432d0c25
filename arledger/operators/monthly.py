"""Monthly collection series per segment slice.

The reference rebuilds the monthly table once per segment in a Python loop. Here the facts are
reduced once, to sums and counts per (customer, status, month): combined before their only shuffle,
so a customer that holds most invoices is a few rows. Segments and the customer tier are attached to
those rows (no join of facts), the rows are summed per (month, region, industry), and every slice -
all, per region, per industry, per pair - is a grouping set of that small table. Slice keys are the
two ``grouping()`` flags plus the trimmed labels (NULL label = "all"); windows (forward fill, lags,
rolling) are partitioned by slice and hold at most one row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    FORECAST_HORIZONS,
    MIN_CLEARED_FOR_SEGMENT_MODEL,
    MIN_MONTHS_FOR_SEGMENT_MODEL,
    MIN_ROWS_FOR_FORECAST_DATASET,
    SEGMENT_COLUMN,
    TIER_LABELS,
)
from ..functions.expressions import cyclic_month, month_label, risk_tier
from .normalize import normalize_selector

SLICE = ["ALL_REGION", "ALL_INDUSTRY", "REGION", "INDUSTRY"]
GROUPING_SETS = [["COLLECT_MONTH"], ["COLLECT_MONTH", "REGION"], ["COLLECT_MONTH", "INDUSTRY"],
                 ["COLLECT_MONTH", "REGION", "INDUSTRY"]]


def horizon_months(days: int) -> int:
    """h = max(1, round(days / 30))."""
    return max(1, int(round(days / 30.0)))


#: Sums and counts that a mean can be taken from after any further grouping.
PARTS = ["amount", "n", "days", "n_days", "late", "n_late", "n_rows"]


def customer_months(inv: DataFrame) -> DataFrame:
    """Invoices reduced to (KUNNR, STATUS, COLLECT_MONTH): the clearing month of cleared items, the
    document month of open ones."""
    month = F.when(F.col("STATUS") == "CLEARED", month_label(F.col("AUGDT"))).otherwise(month_label(F.col("BLDAT")))
    return inv.groupBy("KUNNR", "STATUS", month.alias("COLLECT_MONTH")).agg(
        F.sum("DMBTR").alias("amount"), F.count("BELNR").alias("n"),
        F.sum("DAYS_LATE").alias("days"), F.count("DAYS_LATE").alias("n_days"),
        F.sum("LATE_FLAG").alias("late"), F.count("LATE_FLAG").alias("n_late"), F.count(F.lit(1)).alias("n_rows"),
    )


def customer_tier(cm: DataFrame, asof: bool = False) -> DataFrame:
    """M1: whole-history customer late rate over cleared invoices -> tier; customers without any
    (and rows without a customer) get 'Medium'. A customer has a few rows per month. ``asof=True``
    counts only what was cleared in earlier months than the row's."""
    w = Window.partitionBy("KUNNR")
    if asof:
        w = w.orderBy(F.regexp_replace("COLLECT_MONTH", "-", "").cast("int")).rangeBetween(Window.unboundedPreceding, -1)
    cleared = F.col("STATUS") == "CLEARED"
    late, n = F.sum(F.when(cleared, F.col("late"))).over(w), F.sum(F.when(cleared, F.col("n_late"))).over(w)
    rate = F.when(F.col("KUNNR").isNotNull() & (n > 0), late / n)
    tier = F.when(rate.isNotNull(), risk_tier(rate)).otherwise(F.lit(TIER_LABELS[1]))
    return cm.withColumn("RISK_TIER", tier)


def attach_segments(cm: DataFrame, segments: DataFrame) -> DataFrame:
    """INDUSTRY / REGION by customer key (one row per customer), filling only NULLs when the
    columns exist; M1 when there is no tier yet."""
    seg = segments.select("KUNNR", F.col("INDUSTRY").alias("_ind"), F.col("REGION").alias("_reg"))
    tiered = cm if "RISK_TIER" in cm.columns else customer_tier(cm)
    out = tiered.join(seg, "KUNNR", "left")
    for col, src in (("INDUSTRY", "_ind"), ("REGION", "_reg")):
        out = out.withColumn(col, F.coalesce(F.col(col), F.col(src)) if col in cm.columns else F.col(src))
    return out.drop("_ind", "_reg")


def _labels(df: DataFrame) -> DataFrame:
    """Trimmed labels; empty labels count as missing (the selector rule)."""
    out = df
    for c in ("REGION", "INDUSTRY"):
        t = F.trim(F.col(c).cast("string"))
        out = out.withColumn(c, F.when(t != "", t))
    return out


def _slices(parts: DataFrame, sums: list[Column]) -> DataFrame:
    """All slices of a table of one row per (month, region, industry)."""
    g = parts.groupingSets(GROUPING_SETS, "COLLECT_MONTH", "REGION", "INDUSTRY").agg(
        *sums, F.grouping("REGION").alias("ALL_REGION"), F.grouping("INDUSTRY").alias("ALL_INDUSTRY")
    )
    # a NULL label inside a per-segment set is "no segment", not "all": the reference's
    # per-segment loop never builds it
    return g.where(
        ((F.col("ALL_REGION") == 1) | F.col("REGION").isNotNull())
        & ((F.col("ALL_INDUSTRY") == 1) | F.col("INDUSTRY").isNotNull())
        & F.col("COLLECT_MONTH").isNotNull()
    )


def collection_series(cm: DataFrame) -> DataFrame:
    """The collections of the overall series alone (COLLECT_MONTH, ACTUAL_COLLECTIONS), over the same
    months as ``monthly_dataset`` (three earlier months, known days late): for reports that need
    neither segments nor scores."""
    s = cm.where((F.col("STATUS") == "CLEARED") & F.col("COLLECT_MONTH").isNotNull()).groupBy("COLLECT_MONTH").agg(
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("ACTUAL_COLLECTIONS"), F.sum("n_days").alias("_d"), F.sum("n_late").alias("_l"))
    w = Window.orderBy("COLLECT_MONTH")  # one row per month
    known = (F.col("_d") > 0) & (F.col("_l") > 0)
    for k in (1, 2, 3):
        known = known & (F.coalesce(F.lag("_l", k).over(w), F.lit(0)) > 0)
    return s.withColumn("_ok", known).where("_ok").select("COLLECT_MONTH", "ACTUAL_COLLECTIONS")


def _slice_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    cond = [left["COLLECT_MONTH"] == right["COLLECT_MONTH"]] + [left[c].eqNullSafe(right[c]) for c in SLICE]
    keep = [right[c] for c in right.columns if c not in SLICE + ["COLLECT_MONTH"]]
    return left.join(right, cond, how).select(*[left[c] for c in left.columns], *keep)


def monthly_dataset(cm: DataFrame, gl: DataFrame, scored: DataFrame) -> DataFrame:
    """M3-M11 for every slice. ``cm`` is ``customer_months`` with RISK_TIER, REGION, INDUSTRY;
    ``gl`` has FISCPER, HSL; ``scored`` has BLDAT, LATE_PROB, REGION, INDUSTRY."""
    cleared, open_ = F.col("STATUS") == "CLEARED", F.col("STATUS") == "OPEN"
    keys = ["COLLECT_MONTH", "REGION", "INDUSTRY"]
    parts = _labels(cm).groupBy(*keys).agg(
        *[F.sum(F.when(cleared, F.col(c))).alias(c) for c in PARTS],
        F.sum(F.when(cleared & (F.col("RISK_TIER") == TIER_LABELS[2]), F.col("n_rows"))).alias("high"),
        F.sum(F.when(open_, F.col("amount"))).alias("open_amount"), F.sum(F.when(open_, F.col("n"))).alias("open_n"),
    )
    slices = _slices(parts, [F.sum(c).alias(c) for c in [*PARTS, "high", "open_amount", "open_n"]])
    coll = slices.where(F.col("n_rows") > 0).select(  # months with cleared items
        *SLICE, "COLLECT_MONTH",
        F.coalesce("amount", F.lit(0.0)).alias("ACTUAL_COLLECTIONS"),
        F.col("n").alias("N_INVOICES_CLEARED"),
        F.when(F.col("n_days") > 0, F.col("days") / F.col("n_days")).alias("AVG_DAYS_LATE"),
        F.when(F.col("n_late") > 0, F.col("late") / F.col("n_late")).alias("LATE_RATE"),
        (F.coalesce("high", F.lit(0)) / F.col("n_rows")).alias("HIGH_RISK_SHARE"),
        F.coalesce("open_amount", F.lit(0.0)).alias("OPEN_AR_TOTAL"),
        F.coalesce("open_n", F.lit(0)).cast("double").alias("N_OPEN_INVOICES"),
    )
    # LATE_PROB carries 4 decimals: sum it exactly (DECIMAL) so the mean does not depend on the
    # order in which partial sums are merged
    prob = _labels(scored).groupBy(month_label(F.col("BLDAT")).alias("COLLECT_MONTH"), "REGION", "INDUSTRY").agg(
        F.sum(F.col("LATE_PROB").cast("decimal(18,4)")).alias("p"), F.count("LATE_PROB").alias("np"))
    risk = _slices(prob, [(F.sum("p").cast("double") / F.sum("np")).alias("AVG_LATE_PROB")])
    # GL is never segment-filtered: one row per period (bounded by the calendar)
    cash = gl.groupBy(F.col("FISCPER").cast("string").alias("_p")).agg(F.sum("HSL").alias("OPENING_CASH")).select(
        F.date_format(F.to_date(F.col("_p"), "yyyyMM"), "yyyy-MM").alias("COLLECT_MONTH"), "OPENING_CASH"
    )
    df = coll.join(F.broadcast(cash), "COLLECT_MONTH", "left")
    df = _slice_join(df, risk)

    w = Window.partitionBy(*SLICE).orderBy("COLLECT_MONTH")
    ffill = F.last("OPENING_CASH", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.select(
        *SLICE,
        "COLLECT_MONTH",
        "ACTUAL_COLLECTIONS",
        "AVG_DAYS_LATE",
        "LATE_RATE",
        "HIGH_RISK_SHARE",
        F.coalesce("OPEN_AR_TOTAL", F.lit(0.0)).alias("OPEN_AR_TOTAL"),
        F.coalesce("N_OPEN_INVOICES", F.lit(0.0)).alias("N_OPEN_INVOICES"),
        F.coalesce(ffill, F.lit(0.0)).alias("OPENING_CASH"),
        F.coalesce("AVG_LATE_PROB", "LATE_RATE").alias("AVG_LATE_PROB"),
        "N_INVOICES_CLEARED",
    )
    period = F.to_date(F.concat(F.col("COLLECT_MONTH"), F.lit("-01")))
    month = F.month(period)
    sin, cos = cyclic_month(month)
    prev3 = w.rowsBetween(-3, -1)
    full3 = F.count("ACTUAL_COLLECTIONS").over(prev3) == 3
    df = df.select(
        "*",
        period.alias("PERIOD_DT"),
        month.alias("MONTH"),
        F.quarter(period).alias("QUARTER"),
        month.isin(3, 6, 9, 12).cast("int").alias("IS_Q_END"),
        sin.alias("MONTH_SIN"),
        cos.alias("MONTH_COS"),
        *[F.lag("ACTUAL_COLLECTIONS", k).over(w).alias(f"COLLECTIONS_LAG{k}") for k in (1, 2, 3)],
        *[F.lag("LATE_RATE", k).over(w).alias(f"LATE_RATE_LAG{k}") for k in (1, 2, 3)],
        F.when(full3, F.avg("ACTUAL_COLLECTIONS").over(prev3)).alias("COLLECTIONS_ROLL3_MEAN"),
        F.when(full3, F.stddev_samp("ACTUAL_COLLECTIONS").over(prev3)).alias("COLLECTIONS_ROLL3_STD"),
        F.log1p("ACTUAL_COLLECTIONS").alias("LOG_ACTUAL_COLLECTIONS"),
        F.log1p(F.coalesce("OPENING_CASH", F.lit(0.0))).alias("LOG_OPENING_CASH"),
        F.log1p(F.coalesce("OPEN_AR_TOTAL", F.lit(0.0))).alias("LOG_OPEN_AR"),
    )
    # Drop rows with a NULL in any data column (slice labels excluded: NULL means "all")
    data_cols = [c for c in df.columns if c not in SLICE]
    return df.dropna(subset=data_cols)


def select_slice(monthly: DataFrame, region: str | None = None, industry: str | None = None) -> DataFrame:
    """M12 for one (region, industry) selection of the all-slices table."""
    r, i = normalize_selector(region), normalize_selector(industry)
    cond = (F.col("ALL_REGION") == 1) if r is None else ((F.col("ALL_REGION") == 0) & (F.col("REGION") == r))
    cond = cond & ((F.col("ALL_INDUSTRY") == 1) if i is None else ((F.col("ALL_INDUSTRY") == 0) & (F.col("INDUSTRY") == i)))
    return monthly.where(cond)


def build_forecast_dataset(monthly: DataFrame, region: str | None = None, industry: str | None = None,
                           min_rows: int = MIN_ROWS_FOR_FORECAST_DATASET) -> DataFrame:
    """M12 with the size rule: raises when the slice has fewer than ``min_rows`` rows (one count
    of a table of at most one row per month)."""
    df = select_slice(monthly, region, industry)
    if min_rows > 0:
        n = df.count()
        if n < min_rows:
            raise ValueError(f"forecast dataset too small after feature engineering ({n} rows)")
    return df


def segment_summary(monthly: DataFrame, segment: str = SEGMENT_COLUMN) -> DataFrame:
    """Per segment value: months, cleared invoices, eligibility, reason, kept flag."""
    flag_seg = "ALL_REGION" if segment == "REGION" else "ALL_INDUSTRY"
    flag_other = "ALL_INDUSTRY" if segment == "REGION" else "ALL_REGION"
    seg = monthly.where((F.col(flag_seg) == 0) & (F.col(flag_other) == 1))
    agg = seg.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("months"), F.sum("N_INVOICES_CLEARED").alias("cleared_invoices")
    )
    m_ok = F.col("months") >= MIN_MONTHS_FOR_SEGMENT_MODEL
    c_ok = F.col("cleared_invoices") >= MIN_CLEARED_FOR_SEGMENT_MODEL
    reason = F.concat_ws(
        ",",
        F.when(~m_ok, F.lit(f"months<{MIN_MONTHS_FOR_SEGMENT_MODEL}")),
        F.when(~c_ok, F.lit(f"cleared_invoices<{MIN_CLEARED_FOR_SEGMENT_MODEL}")),
    )
    return agg.select(
        "segment", "months", "cleared_invoices",
        (m_ok & c_ok).alias("eligible_for_segment_model"),
        F.when(reason == "", F.lit("eligible")).otherwise(reason).alias("reason"),
        (F.col("months") >= MIN_ROWS_FOR_FORECAST_DATASET).alias("kept_for_pooling"),
    )


def pooled_dataset(monthly: DataFrame, segment: str = SEGMENT_COLUMN) -> DataFrame:
    """Union of the kept segment datasets, or the overall series when none is kept.
    Both candidates are slices of the one long table; the choice is a scalar subquery."""
    flag_seg = "ALL_REGION" if segment == "REGION" else "ALL_INDUSTRY"
    flag_other = "ALL_INDUSTRY" if segment == "REGION" else "ALL_REGION"
    seg_rows = monthly.where((F.col(flag_seg) == 0) & (F.col(flag_other) == 1))
    sizes = seg_rows.groupBy(segment).agg(F.count(F.lit(1)).alias("_months"))
    kept = seg_rows.join(sizes.where(F.col("_months") >= MIN_ROWS_FOR_FORECAST_DATASET), segment, "left_semi")
    any_kept = sizes.agg(F.max((F.col("_months") >= MIN_ROWS_FOR_FORECAST_DATASET).cast("int"))).scalar()
    overall = monthly.where((F.col("ALL_REGION") == 1) & (F.col("ALL_INDUSTRY") == 1))
    return kept.where(F.coalesce(any_kept, F.lit(0)) == 1).unionByName(
        overall.where(F.coalesce(any_kept, F.lit(0)) == 0)
    ).withColumn("global_training_source", F.when(F.coalesce(any_kept, F.lit(0)) == 1, "segment_pooled")
                 .otherwise("overall_only"))


def horizon_targets(monthly: DataFrame, horizons=FORECAST_HORIZONS, train_share: float = 0.8) -> DataFrame:
    """M13 + M14: one row per (slice, month, horizon) with TARGET = collections h rows ahead
    (lead within the slice, never across slices) and the time split: the first
    int(0.8 * rows) rows of the slice (counted before target nulls are dropped) are train."""
    w = Window.partitionBy(*SLICE).orderBy("COLLECT_MONTH")
    base = monthly.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(Window.partitionBy(*SLICE)).alias("_n"),
        *[F.lead("ACTUAL_COLLECTIONS", horizon_months(h)).over(w).alias(f"_t{h}") for h in horizons],
    )
    stacked = ", ".join(f"{h}, `_t{h}`" for h in horizons)
    out = base.select(
        "*", F.expr(f"stack({len(horizons)}, {stacked}) AS (HORIZON_DAYS, TARGET)")
    ).drop(*[f"_t{h}" for h in horizons])
    split = F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(train_share)), "train").otherwise("test")
    return out.where(F.col("TARGET").isNotNull()).withColumn("split", split).drop("_rn", "_n")
