"""Portfolio questions (dashboard and EDA) as DataFrames.

Every query is a hash aggregate (map-side partial), a distributed top-k (``orderBy().limit()``
plans as TakeOrderedAndProject: each task keeps k rows), or a window over an already aggregated
small table. Grand totals are scalar subqueries, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AGING_BUCKETS, FEATURE_COLS, TARGET_COL, TOP_N_RISKS
from ..functions.expressions import quarter_label, risk_tier
from .metrics import equal_width_bins
from .normalize import apply_segment_filters
from .stats import exact_quantiles

QUEUE_COLS = ["BELNR", "KUNNR", "INDUSTRY", "REGION", "DMBTR", "FAEDT", "LATE_PROB", "RISK_LABEL"]


def kpis(scored: DataFrame, threshold: float, region: str | None = None, industry: str | None = None,
         forecast: DataFrame | None = None, horizon: int = 30) -> DataFrame:
    """Total AR, at-risk AR (rounded prob >= threshold), share, flagged n, total n, mean risk; with a
    forecast also its median for the chosen horizon and half of its range (null without that horizon)."""
    f = apply_segment_filters(scored, region, industry)
    flag = F.col("LATE_PROB") >= F.lit(float(threshold))
    agg = f.agg(
        F.coalesce(F.sum("DMBTR"), F.lit(0.0)).alias("total_ar"),
        F.coalesce(F.sum(F.when(flag, F.col("DMBTR"))), F.lit(0.0)).alias("at_risk_ar"),
        F.count_if(flag).alias("n_flagged"),
        F.count(F.lit(1)).alias("n_total"),
        F.coalesce(F.avg("LATE_PROB"), F.lit(0.0)).alias("avg_risk"),
    )
    share = F.when(F.col("total_ar") > 0, F.col("at_risk_ar") / F.col("total_ar")).otherwise(0.0)
    out = agg.select("total_ar", "at_risk_ar", share.alias("risk_share"), "n_flagged", "n_total", "avg_risk")
    if forecast is None:
        return out
    chosen = forecast.where(F.col("Horizon_Days") == horizon).agg(
        F.first("Median_50pct").alias("m"), F.first((F.col("Upper_90pct") - F.col("Lower_10pct")) / 2).alias("w"))
    return out.withColumns({"forecast_median": chosen.select("m").scalar(), "forecast_half_width": chosen.select("w").scalar()})


def top_risk_queue(scored: DataFrame, threshold: float, n: int = TOP_N_RISKS,
                   region: str | None = None, industry: str | None = None) -> DataFrame:
    """Flagged invoices by probability (ties by BELNR), top n, eight columns."""
    f = apply_segment_filters(scored, region, industry)
    return (
        f.where(F.col("LATE_PROB") >= F.lit(float(threshold)))
        .orderBy(F.desc("LATE_PROB"), F.asc("BELNR"))
        .limit(n)
        .select(*QUEUE_COLS)
    )


def filter_values(df: DataFrame, cols=("INDUSTRY", "REGION")) -> DataFrame:
    """Trimmed, non-empty, distinct values per filter column."""
    pairs = ", ".join(f"'{c}', trim(CAST(`{c}` AS STRING))" for c in cols)
    long = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (segment, value)"))
    return long.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def histogram(df: DataFrame, col: str, n_bins: int, clip: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width histogram over the column's own [min, max]."""
    x = F.col(col).cast("double")
    if clip is not None:
        x = F.least(F.greatest(x, F.lit(float(clip[0]))), F.lit(float(clip[1])))
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    rng = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    idx, left, _ = equal_width_bins(F.col("x"), lo, hi, n_bins)
    return vals.groupBy(idx.alias("bin")).agg(F.first(left).alias("bin_left"), F.count(F.lit(1)).alias("n"))


def aging_top(aging: DataFrame, n: int = 20) -> DataFrame:
    """N largest open totals (ties by KUNNR), bucket values in thousands."""
    top = aging.orderBy(F.desc("TOTAL_OUTSTANDING"), F.asc("KUNNR")).limit(n)
    return top.select("KUNNR", *[(F.col(f"`{b}`") / 1e3).alias(b) for b in AGING_BUCKETS],
                      (F.col("TOTAL_OUTSTANDING") / 1e3).alias("TOTAL_K"))


def segment_bars(scored: DataFrame, segment: str) -> DataFrame:
    """Mean and count of the probability per segment value with a colour class."""
    agg = scored.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.avg("LATE_PROB").alias("mean_prob"), F.count(F.lit(1)).alias("n")
    )
    cls = F.when(F.col("mean_prob") > 0.5, "high").when(F.col("mean_prob") > 0.3, "medium").otherwise("low")
    return agg.select(F.col(segment).alias("value"), "mean_prob", "n", cls.alias("color_class"))


def late_rate_trend(df: DataFrame) -> DataFrame:
    """Mean LATE_FLAG * 100 per document quarter ('2022Q1')."""
    return df.where(F.col("BLDAT").isNotNull()).groupBy(quarter_label(F.col("BLDAT")).alias("PERIOD")).agg(
        (F.avg(TARGET_COL) * 100).alias("late_pct")
    )


def status_summary(invoices: DataFrame) -> DataFrame:
    """Counts by status, document date range, total and open AR."""
    return invoices.agg(
        F.count_if(F.col("STATUS") == "CLEARED").alias("n_cleared"),
        F.count_if(F.col("STATUS") == "OPEN").alias("n_open"),
        F.min("BLDAT").alias("first_date"),
        F.max("BLDAT").alias("last_date"),
        F.coalesce(F.sum("DMBTR"), F.lit(0.0)).alias("total_ar"),
        F.coalesce(F.sum(F.when(F.col("STATUS") == "OPEN", F.col("DMBTR"))), F.lit(0.0)).alias("open_ar"),
    )


def customer_risk_view(customers: DataFrame, invoices: DataFrame, missing_rate: float = 0.0) -> DataFrame:
    """P29 (EDA): customer late rate over cleared invoices; customers without any get
    ``missing_rate`` (0, i.e. Low; M1 uses Medium instead)."""
    rates = invoices.where((F.col("STATUS") == "CLEARED") & F.col("KUNNR").isNotNull()).groupBy("KUNNR").agg(
        F.avg(TARGET_COL).alias("_rate")
    )
    out = customers.join(rates, "KUNNR", "left")
    out = out.withColumn("CUSTOMER_LATE_RATE", F.coalesce(F.col("_rate"), F.lit(float(missing_rate)))).drop("_rate")
    return out.withColumn("RISK_TIER", risk_tier(F.col("CUSTOMER_LATE_RATE")))


def value_shares(df: DataFrame, col: str, dimension: str | None = None) -> DataFrame:
    """Value counts and share of the total (the total is a scalar subquery)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    agg = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.lit(dimension or col).alias("dimension"), "value", "n", (F.col("n") / total).alias("share"))


def five_number_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """Min, quartiles, max per group (exact, interpolated)."""
    q = exact_quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [group])
    return q.select(
        group, "n", F.col("q0").alias("min"), F.col("q1").alias("q1"), F.col("q2").alias("median"),
        F.col("q3").alias("q3"), F.col("q4").alias("max"),
    )


def crosstab_row_pct(df: DataFrame, row: str, col: str, col_values: list[str]) -> DataFrame:
    """Counts of (row, col) as percent of the row total, fixed column list."""
    counts = df.where(F.col(row).isNotNull()).groupBy(row).pivot(col, col_values).count().fillna(0)
    total = None
    for v in col_values:
        total = F.col(v) if total is None else total + F.col(v)
    return counts.select(row, *[(F.col(v) * 100.0 / total).alias(v) for v in col_values])


def customer_totals(invoices: DataFrame) -> DataFrame:
    """Cleared invoices summed per customer: counts and sums that rates can be taken from (a
    customer that holds most invoices is one row before segments are joined)."""
    late = F.col("DAYS_LATE") > 0
    return invoices.where(F.col("STATUS") == "CLEARED").groupBy("KUNNR").agg(
        F.count(TARGET_COL).alias("n"), F.sum(TARGET_COL).alias("late"),
        F.count_if(late).alias("n_when"), F.sum(F.when(late, F.col("DAYS_LATE"))).alias("days_when"),
    )


def late_rates(totals: DataFrame) -> DataFrame:
    """Late rate (%) by customer tier and by industry, overall, and mean days when late, from
    customer totals with RISK_TIER and INDUSTRY (one aggregate over all groupings)."""
    g = totals.groupingSets([["RISK_TIER"], ["INDUSTRY"], []], "RISK_TIER", "INDUSTRY").agg(
        F.sum("late").alias("late"), F.sum("n").alias("n"), F.sum("days_when").alias("days"), F.sum("n_when").alias("n_when"),
        F.grouping("RISK_TIER").alias("gt"), F.grouping("INDUSTRY").alias("gi"))
    rate = F.col("late") / F.col("n") * 100
    one = lambda dim, value, metric: F.struct(dim.alias("dimension"), value.alias("value"), metric.alias("metric"))
    tier = F.array(one(F.lit("RISK_TIER"), F.col("RISK_TIER"), rate))
    industry = F.array(one(F.lit("INDUSTRY"), F.col("INDUSTRY"), rate))
    both = F.array(one(F.lit("overall"), F.lit("late_rate_pct"), rate),
                   one(F.lit("overall"), F.lit("avg_days_when_late"), F.when(F.col("n_when") > 0, F.col("days") / F.col("n_when"))))
    rows = F.when(F.col("gt") == 0, tier).when(F.col("gi") == 0, industry).otherwise(both)
    return g.select(F.explode(rows).alias("r")).select("r.*").where("value is not null")


def seeded_sample(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Deterministic sample of n rows: order by the MD5 of key and seed (top-k)."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)).limit(n)


def aging_bucket_totals(aging: DataFrame) -> DataFrame:
    """P20: total per bucket and share of all open AR (percent, 1 decimal half-even)."""
    pairs = ", ".join(f"'{b}', `{b}`" for b in AGING_BUCKETS)
    long = aging.select(F.expr(f"stack({len(AGING_BUCKETS)}, {pairs}) AS (bucket, amount)"))
    tot = long.groupBy("bucket").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    grand = tot.agg(F.sum("total")).scalar()
    return tot.select("bucket", "total", F.bround(F.col("total") / grand * 100, 1).alias("pct"))


def aging_overview(aging_eda: DataFrame) -> DataFrame:
    """P20: total open, total overdue, mean overdue share per customer."""
    return aging_eda.agg(
        F.coalesce(F.sum("TOTAL_OUTSTANDING"), F.lit(0.0)).alias("total_open"),
        F.coalesce(F.sum("OVERDUE_TOTAL"), F.lit(0.0)).alias("total_overdue"),
        F.avg("OVERDUE_PCT").alias("avg_overdue_pct"),
    )


def top_concentration(aging: DataFrame, n: int = 20) -> DataFrame:
    """Share (%) of open AR held by the n largest customers."""
    top = aging.orderBy(F.desc("TOTAL_OUTSTANDING"), F.asc("KUNNR")).limit(n)
    grand = aging.agg(F.sum("TOTAL_OUTSTANDING")).scalar()
    return top.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.sum("TOTAL_OUTSTANDING").alias("top_total"),
        (F.sum("TOTAL_OUTSTANDING") / grand * 100).alias("top_share_pct"),
    )


def cash_by_period(gl_eda: DataFrame, by_account: bool = False) -> DataFrame:
    """GL balance per period (optionally per account name)."""
    keys = ["PERIOD", "ACCT_NAME"] if by_account else ["PERIOD"]
    return gl_eda.groupBy(*keys).agg(F.sum("HSL").alias("HSL"))


def _long_features(fs: DataFrame, cols: list[str], extra: list[str] | None = None) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return fs.select(*(extra or []), F.expr(f"stack({len(cols)}, {pairs}) AS (feature, value)"))


def null_counts(fs: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """Null count per feature (one aggregate pass)."""
    agg = fs.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {pairs}) AS (feature, n_null)"))


def describe(fs: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per feature."""
    long = _long_features(fs, cols)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature"])
    return moments.join(q.select("feature", F.col("q0").alias("p25"), F.col("q1").alias("p50"),
                                 F.col("q2").alias("p75")), "feature", "left")


def correlation_long(fs: DataFrame, cols: list[str]) -> DataFrame:
    """P25: Pearson correlation of every ordered pair (and the diagonal).

    Two passes instead of one aggregate per pair: the column means (one row, attached as a
    scalar struct subquery), then one aggregate of centred cross products - plain sums that
    stay inside whole-stage codegen. Rows with a NULL in any of the columns are left out (the
    feature store has none after F27)."""
    x = fs.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    means = x.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    centred = x.select(*[(F.col(c) - means[c]).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
    items = []
    for a, b in pairs:
        r = f"`{a}__{b}` / sqrt(`{a}__{a}` * `{b}__{b}`)"
        items += [f"'{a}'", f"'{b}'", r]
        if a != b:
            items += [f"'{b}'", f"'{a}'", r]
    n = len(items) // 3
    return sums.select(F.expr(f"stack({n}, {', '.join(items)}) AS (feature_a, feature_b, corr)"))


# FIXED VALUES: why each model feature is expected to matter
RATIONALE = {
    "CUST_LATE_RATE": "payment history", "CUST_AVG_DAYS_LATE": "payment history", "CUST_INVOICE_COUNT": "relationship length",
    "CUST_AVG_AMOUNT": "usual size", "LOG_AMOUNT": "approval effort", "PAYMENT_DAYS_NUM": "contract terms",
    "INDUSTRY_CODE": "sector practice", "REGION_CODE": "regional practice", "INVOICE_MONTH": "season",
    "INVOICE_QUARTER": "season", "INVOICE_DOW": "processing day", "IS_QUARTER_END": "period close",
}


def feature_rationale(fs: DataFrame, cols: list[str] = FEATURE_COLS, target: str = TARGET_COL) -> DataFrame:
    """P25: every model feature with its reason and its correlation with the target, strongest first."""
    reasons = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(RATIONALE.get(c, "")))])
    return target_correlation(fs, cols, target).select("rank", "feature", F.element_at(reasons, F.col("feature")).alias("rationale"), "corr")


def target_correlation(fs: DataFrame, cols: list[str] = FEATURE_COLS, target: str = TARGET_COL) -> DataFrame:
    """P25: correlation of each feature with the target, ranked by absolute value."""
    one = fs.agg(*[F.corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = one.select(F.expr(f"stack({len(cols)}, {pairs}) AS (feature, corr)"))
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), "feature")))


def class_distributions(fs: DataFrame, cols: list[str] = FEATURE_COLS, target: str = TARGET_COL,
                        n_bins: int = 30) -> DataFrame:
    """Per feature and class, values clipped to the class's 1st/99th percentile and
    binned in 30 equal bins over the clipped range; density = n / (N * width)."""
    long = _long_features(fs, cols, [F.col(target).alias("label")]).where(F.col("value").isNotNull())
    pct = exact_quantiles(long, "value", [0.01, 0.99], ["feature", "label"]).select(
        "feature", "label", F.col("q0").alias("p01"), F.col("q1").alias("p99"), F.col("n").alias("N")
    )
    j = long.join(F.broadcast(pct), ["feature", "label"])  # one row per (feature, class)
    x = F.least(F.greatest(F.col("value"), F.col("p01")), F.col("p99"))
    idx, left, width = equal_width_bins(x, F.col("p01"), F.col("p99"), n_bins)
    return j.groupBy("feature", "label", idx.alias("bin")).agg(
        F.first(left).alias("bin_left"), F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / (F.first("N") * F.first(width))).alias("density"),
    )


def segment_risk_stats(scored: DataFrame, segment: str = "INDUSTRY") -> DataFrame:
    """Mean, sample std and count of the probability per segment, rounded to 3."""
    return scored.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.bround(F.avg("LATE_PROB"), 3).alias("mean"),
        F.bround(F.stddev_samp("LATE_PROB"), 3).alias("std"),
        F.count(F.lit(1)).alias("count"),
    )


def run_summary(customers: DataFrame, invoices: DataFrame, aging: DataFrame, gl: DataFrame) -> DataFrame:
    """Customers, invoices, open and cleared items, late rate, aging and GL rows."""
    inv = invoices.agg(
        F.count(F.lit(1)).alias("n_invoices"),
        F.count_if(F.col("AUGDT").isNull()).alias("n_open"),
        F.count_if(F.col("AUGDT").isNotNull()).alias("n_cleared"),
        F.coalesce(F.avg(F.when(F.col("AUGDT").isNotNull(), F.col(TARGET_COL))), F.lit(0.0)).alias("late_rate"),
    )
    return inv.select(
        customers.agg(F.count(F.lit(1))).scalar().alias("n_customers"),
        "n_invoices", "n_open", "n_cleared", "late_rate",
        aging.agg(F.count(F.lit(1))).scalar().alias("n_aging_rows"),
        gl.agg(F.count(F.lit(1))).scalar().alias("n_gl_rows"),
    )


def export_summary(scored: DataFrame, threshold: float, forecast: DataFrame | None = None,
                   n: int = TOP_N_RISKS) -> DataFrame:
    """Flagged top-n count, their AR, mean risk, and the 30-day median forecast."""
    top = top_risk_queue(scored, threshold, n)
    out = top.agg(
        F.count(F.lit(1)).alias("n_export"),
        F.coalesce(F.sum("DMBTR"), F.lit(0.0)).alias("at_risk_ar"),
        F.coalesce(F.avg("LATE_PROB"), F.lit(0.0)).alias("avg_risk"),
    )
    if forecast is not None:
        med = forecast.where(F.col("Horizon_Days") == 30).agg(F.first("Median_50pct")).scalar()
        out = out.withColumn("forecast_30d_median", med)
    return out


def risk_band(prob: Column) -> Column:
    """P12 colour band: >= .7 high, >= .5 elevated, else normal."""
    return F.when(prob >= 0.7, "high").when(prob >= 0.5, "elevated").otherwise("normal")


def report_invoice_table(flagged_top: DataFrame) -> DataFrame:
    """P12 invoice table: invoice, customer (first 12 characters), industry, amount, due date,
    score and its colour band."""
    return flagged_top.select(
        F.col("BELNR").alias("Invoice"),
        F.substring(F.col("KUNNR").cast("string"), 1, 12).alias("Customer"),
        F.col("INDUSTRY").alias("Industry"),
        F.col("DMBTR").alias("Amount"),
        F.col("FAEDT").alias("Due_Date"),
        F.col("LATE_PROB").alias("Risk_Score"),
        risk_band(F.col("LATE_PROB")).alias("Risk_Band"),
    )


def report_summary_table(flagged_top: DataFrame, cv_auc: float | None, threshold: float) -> DataFrame:
    """P12 summary table: (metric, value) rows for the audit export."""
    agg = flagged_top.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.coalesce(F.sum("DMBTR"), F.lit(0.0)).alias("ar"),
        F.avg("LATE_PROB").alias("risk"),
    )
    rows = F.array(
        F.struct(F.lit("Flagged invoices").alias("metric"), F.col("n").alias("value")),
        F.struct(F.lit("Total at-risk AR").alias("metric"), F.col("ar").alias("value")),
        F.struct(F.lit("Average risk score").alias("metric"), F.col("risk").alias("value")),
        F.struct(F.lit("Model CV AUC-ROC").alias("metric"), F.lit(cv_auc).cast("double").alias("value")),
        F.struct(F.lit("Risk threshold").alias("metric"), F.lit(float(threshold)).alias("value")),
    )
    return agg.select(F.explode(rows).alias("r")).select("r.*")
