"""Query definitions, grouped by survey section. Each returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (
    AGING_BUCKETS,
    FEATURE_COLS,
    INDUSTRY_DEFAULT,
    INDUSTRY_MAP,
    REGION_DEFAULT,
    REGION_MAP,
)
from pyspark.sql import functions as F  # noqa: F811
from ..operators import aging
from . import oracle as O
from .registry import precision, register

# ----------------------------------------------------------------------------------------------
# 2.10 P1: AR aging (minimum end-to-end slice)
# ----------------------------------------------------------------------------------------------


@precision({'Current': 2, '1-30 days': 2, '31-60 days': 2, '61-90 days': 2, '91-180 days': 2, '180+ days': 2, 'TOTAL_OUTSTANDING': 2})
@register(
    "p1_ar_aging",
    O.rounded(
        O.with_prefix(O.AGING_CTE, select="SELECT * FROM aging"),
        AGING_BUCKETS + ["TOTAL_OUTSTANDING"],
    ),
)
def p1_ar_aging(inp):
    """Open AR per customer by aging bucket as of the last order date."""
    return aging.ar_aging(inp.invoices)


# ----------------------------------------------------------------------------------------------
# 2.4-2.5 F: feature store
# ----------------------------------------------------------------------------------------------
from ..operators import features  # noqa: E402


@register("f26_feature_store", O.rounded(O.with_prefix(*O.FS_CTES, select="SELECT * FROM fs"), O.FS_DOUBLES))
def f26_feature_store(inp):
    """35-column feature store: prior-only customer history, calendar, codes, GL context."""
    return inp.feature_store


@register(
    "f28_time_split",
    O.with_prefix(*O.FS_CTES, O.SPLIT_CTE, select="SELECT BELNR, KUNNR, BLDAT, split FROM split"),
)
def f28_time_split(inp):
    """Exact 80/20 cut by document date (ties by BELNR)."""
    return features.time_split(inp.feature_store).select("BELNR", "KUNNR", "BLDAT", "split")


@register(
    "f30_split_summary",
    O.with_prefix(
        *O.FS_CTES, O.SPLIT_CTE,
        select="SELECT split, count(*) AS n_rows, min(BLDAT) AS min_date, max(BLDAT) AS max_date FROM split GROUP BY split",
    ),
)
def f30_split_summary(inp):
    """Rows and date range per split."""
    return features.split_summary(features.time_split(inp.feature_store))


@register(
    "f29_feature_store_summary",
    O.rounded(
        O.with_prefix(
            *O.FS_CTES,
            select="SELECT count(*) AS n_rows, 35 AS n_cols, avg(LATE_FLAG) AS late_rate, "
            + ", ".join(
                f"round_even(avg(CAST(RISK_TIER = '{t}' AS DOUBLE)), 3) AS share_{t.lower()}"
                for t in ("Low", "Medium", "High")
            )
            + " FROM fs",
        ),
        ["late_rate", "share_low", "share_medium", "share_high"],
    ),
)
def f29_feature_store_summary(inp):
    """Row/column count, late rate and tier shares."""
    return features.feature_store_summary(inp.feature_store)


# ----------------------------------------------------------------------------------------------
# 2.3 Q: data-quality rules
# ----------------------------------------------------------------------------------------------
from ..operators import quality  # noqa: E402


def _quality_tables(inp):
    return {
        "customer_master": inp.customers_raw,
        "invoice_history": inp.invoices_raw,
        "ar_aging": inp.aging,
        "gl_cash_positions": inp.gl_raw,
    }


@register("q10_validate_all", O.quality_sql())
def q10_validate_all(inp):
    """Every rule of the four raw tables in one long report."""
    return quality.validate_all(_quality_tables(inp))


@register(
    "q9_class_balance",
    O.rounded(
        O.with_prefix(
            select="SELECT n_cleared, n_late, n_cleared - n_late AS n_on_time, "
            "n_late / greatest(n_cleared, 1) AS late_share, (n_cleared - n_late) / greatest(n_cleared, 1) AS on_time_share, "
            "n_late / greatest(n_cleared, 1) < 0.1 AS imbalance_warning FROM ("
            "SELECT count(*) AS n_cleared, count_if(coalesce(datediff('day', FAEDT, AUGDT) > 0, false)) AS n_late "
            "FROM inv WHERE AUGDT IS NOT NULL)"
        ),
        ["late_share", "on_time_share"],
    ),
)
def q9_class_balance(inp):
    """Cleared / late / on-time counts and shares."""
    return quality.class_balance_report(inp.invoices_raw)


# ----------------------------------------------------------------------------------------------
# 2.6-2.7 C6, C7, E: scoring and evaluation on the stand-in score (test split as in the source)
# ----------------------------------------------------------------------------------------------
from ..operators import metrics  # noqa: E402

_SCORED_COLS = ["BELNR", "KUNNR", "LATE_FLAG", "LATE_PROB", "LATE_PRED", "RISK_LABEL"]


@register(
    "c7_predict",
    O.rounded(O.with_prefix(*O.SCORED, select=f"SELECT {', '.join(_SCORED_COLS)} FROM scored"),
              ["LATE_FLAG", "LATE_PROB"]),
)
def c7_predict(inp):
    """LATE_PROB (half-even, 4 places), LATE_PRED, RISK_LABEL for every feature-store row."""
    return inp.scored.select(*_SCORED_COLS)


@register(
    "c6_optimize_threshold",
    O.rounded(
        O.with_prefix(
            *O.SCORED_TEST,
            *O.grid_metrics_ctes("scored_test", metrics.threshold_grid()),
            """sel AS (SELECT *, least(0.85, base_rate + CAST(0.1 AS DOUBLE)) AS max_flag_rate,
                 CASE WHEN flag_rate <= least(0.85, base_rate + CAST(0.1 AS DOUBLE)) THEN 0
                      WHEN flag_rate <= CAST(0.95 AS DOUBLE) THEN 1 ELSE 2 END AS lvl FROM gm)""",
            select="SELECT threshold, f1, precision, recall, flag_rate, base_rate, max_flag_rate FROM sel "
            "WHERE lvl <= (SELECT min(lvl) FROM sel) ORDER BY f1 DESC, k ASC LIMIT 1",
        ),
        ["threshold", "f1", "precision", "recall", "flag_rate", "base_rate", "max_flag_rate"],
    ),
)
def c6_optimize_threshold(inp):
    """Best-F1 threshold on the 61-point grid under the flag-rate guardrail."""
    return metrics.optimize_threshold(inp.scored_test)


@register(
    "c6_threshold_grid",
    O.rounded(
        O.with_prefix(*O.SCORED_TEST, *O.grid_metrics_ctes("scored_test", metrics.threshold_grid()),
                      select="SELECT * FROM gm"),
        ["threshold", "precision", "recall", "f1", "flag_rate", "base_rate"],
    ),
)
def c6_threshold_grid(inp):
    """Precision / recall / F1 / flag rate at each of the 61 grid thresholds."""
    return metrics.grid_metrics(inp.scored_test, metrics.threshold_grid())


@register(
    "e10_threshold_sensitivity",
    O.rounded(
        O.with_prefix(*O.SCORED_TEST, *O.grid_metrics_ctes("scored_test", metrics.sensitivity_grid()),
                      select="SELECT * FROM gm"),
        ["threshold", "precision", "recall", "f1", "flag_rate", "base_rate"],
    ),
)
def e10_threshold_sensitivity(inp):
    """F1 / precision / recall over the 80-point sensitivity grid."""
    return metrics.grid_metrics(inp.scored_test, metrics.sensitivity_grid())


@register(
    "e1_e3_ranking_metrics",
    O.rounded(
        O.with_prefix(
            *O.SCORED_TEST, *O.ranking_ctes("scored_test"),
            select=f"SELECT {O.AUC_SQL} AS auc_roc, {O.AP_SQL} AS auc_pr, "
            "(SELECT avg(pow(LATE_PROB - LATE_FLAG, 2)) FROM scored_test) AS brier FROM rp",
        ),
        ["auc_roc", "auc_pr", "brier"],
    ),
)
def e1_e3_ranking_metrics(inp):
    """AUC-ROC (ties averaged), step AUC-PR, Brier on the test split."""
    return metrics.ranking_metrics(inp.scored_test)


@register(
    "e5_confusion_matrix",
    O.with_prefix(
        *O.SCORED_TEST,
        select="SELECT count_if(LATE_FLAG <> 1 AND LATE_PRED <> 1) AS tn, count_if(LATE_FLAG <> 1 AND LATE_PRED = 1) AS fp, "
        "count_if(LATE_FLAG = 1 AND LATE_PRED <> 1) AS fn, count_if(LATE_FLAG = 1 AND LATE_PRED = 1) AS tp FROM scored_test",
    ),
)
def e5_confusion_matrix(inp):
    """tn, fp, fn, tp at the decision threshold."""
    return metrics.confusion(inp.scored_test)


_E4_SQL = O.rounded(
    O.with_prefix(
        *O.SCORED_TEST,
        "cm AS (SELECT count_if(LATE_FLAG <> 1 AND LATE_PRED <> 1) AS tn, count_if(LATE_FLAG <> 1 AND LATE_PRED = 1) AS fp, "
        "count_if(LATE_FLAG = 1 AND LATE_PRED <> 1) AS fn, count_if(LATE_FLAG = 1 AND LATE_PRED = 1) AS tp FROM scored_test)",
        """pc AS (
  SELECT tn, fp, fn, tp, tn + fp AS s0, tp + fn AS s1,
    CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
    CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0.0 END AS f0,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM cm)""",
        select="""SELECT 'On time' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM pc
UNION ALL SELECT 'Late', p1, r1, f1, s1 FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (s0 + s1), s0 + s1 FROM pc
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM pc
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
  (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM pc""",
    ),
    ["precision", "recall", "f1_score"],
)


@register("e4_classification_report", _E4_SQL)
def e4_classification_report(inp):
    """Per-class precision, recall, F1, support; accuracy; macro and weighted averages."""
    return metrics.classification_report(inp.scored_test)


# E6-E9, E11, E12 --------------------------------------------------------------------------------


@register("e6_roc_points", O.rounded(O.with_prefix(*O.SCORED_TEST, *O.ranking_ctes("scored_test"), select=(
    "SELECT s AS threshold, CASE WHEN N > 0 THEN fp / N END AS fpr, CASE WHEN P > 0 THEN tp / P END AS tpr FROM rp")),
    ["threshold", "fpr", "tpr"]))
def e6_roc_points(inp):
    """ROC curve points at every distinct test score."""
    return metrics.roc_points(inp.scored_test)


@register("e7_pr_points", O.rounded(O.with_prefix(*O.SCORED_TEST, *O.ranking_ctes("scored_test"), select=(
    "SELECT s AS threshold, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P END AS recall FROM rp")),
    ["threshold", "precision", "recall"]))
def e7_pr_points(inp):
    """Precision-recall points at every distinct test score."""
    return metrics.pr_points(inp.scored_test)


@register("e8_calibration_curve", O.rounded(O.with_prefix(*O.SCORED_TEST, select=(
    f"SELECT {O.count_le_sql(metrics.calibration_edges(), 'LATE_PROB', strict=True)} AS bin, "
    "avg(LATE_PROB) AS prob_pred, avg(LATE_FLAG) AS prob_true, count(*) AS n FROM scored_test GROUP BY 1")),
    ["prob_pred", "prob_true"]))
def e8_calibration_curve(inp):
    """Ten right-closed probability bins: mean prediction vs observed late share."""
    return metrics.calibration_curve(inp.scored_test)


@precision({'bin_left': 9})
@register("e9_score_histogram_by_class", O.rounded(O.with_prefix(
    *O.SCORED_TEST,
    *O.hist_ctes("h", "SELECT LATE_FLAG AS label, LATE_PROB AS x FROM scored_test", 40, ["label"]),
    select="SELECT label, bin, first(f + bin * ((l - f) / 40)) AS bin_left, count(*) AS n, "
    "count(*) / (first(NN) * first((l - f) / 40)) AS density FROM h_b GROUP BY label, bin"),
    ["label", "density"]))
def e9_score_histogram_by_class(inp):
    """40-bin density histogram of the score per class over each class's own range."""
    return metrics.class_histogram(inp.scored_test)


_SEG_LONG = ("seg_long AS (SELECT 'INDUSTRY' AS segment, CAST(INDUSTRY AS VARCHAR) AS value, LATE_FLAG, LATE_PROB, LATE_PRED "
             "FROM scored_test WHERE INDUSTRY IS NOT NULL UNION ALL SELECT 'REGION', CAST(REGION AS VARCHAR), LATE_FLAG, "
             "LATE_PROB, LATE_PRED FROM scored_test WHERE REGION IS NOT NULL)")


@register("e11_segment_analysis", O.rounded(O.with_prefix(
    *O.SCORED_TEST, _SEG_LONG, *O.ranking_ctes("seg_long", ["segment", "value"]),
    f"auc AS (SELECT segment, value, {O.AUC_SQL} AS auc_roc FROM rp GROUP BY segment, value)",
    "base AS (SELECT segment, value, count(*) AS n, avg(LATE_FLAG) AS late_share, avg(LATE_PRED) AS flagged_share "
    "FROM seg_long GROUP BY segment, value)",
    select="SELECT base.*, auc.auc_roc FROM base LEFT JOIN auc USING (segment, value) WHERE n >= 10"),
    ["late_share", "flagged_share", "auc_roc"]))
def e11_segment_analysis(inp):
    """Per industry / region value (n >= 10): n, late share, AUC, flagged share."""
    return metrics.segment_analysis(inp.scored_test)


@precision({'total_ar': 2, 'flagged_ar': 2, 'missed_ar': 2})
@register("e12_business_impact", O.rounded(O.with_prefix(*O.SCORED_TEST, select=(
    "SELECT total_ar, flagged_ar, flagged_ar / greatest(total_ar, 1.0) AS flagged_share, missed_ar, "
    "missed_ar / greatest(total_ar, 1.0) AS missed_share FROM (SELECT coalesce(sum(DMBTR), 0.0) AS total_ar, "
    "coalesce(sum(CASE WHEN LATE_PRED = 1 THEN DMBTR END), 0.0) AS flagged_ar, "
    "coalesce(sum(CASE WHEN LATE_FLAG = 1 AND LATE_PRED = 0 THEN DMBTR END), 0.0) AS missed_ar FROM scored_test)")),
    ["total_ar", "flagged_ar", "flagged_share", "missed_ar", "missed_share"]))
def e12_business_impact(inp):
    """AR flagged for action and AR missed (late but not flagged) on the test split."""
    return metrics.business_impact(inp.scored_test)


# ----------------------------------------------------------------------------------------------
# 2.10 P: portfolio analytics
# ----------------------------------------------------------------------------------------------
from ..operators import normalize, portfolio  # noqa: E402

_T = f"CAST({O._threshold()} AS DOUBLE)"


@precision({'total_ar': 2, 'at_risk_ar': 2})
@register("p2_kpis", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT total_ar, at_risk_ar, CASE WHEN total_ar > 0 THEN at_risk_ar / total_ar ELSE 0.0 END AS risk_share, "
    "n_flagged, n_total, avg_risk FROM (SELECT coalesce(sum(DMBTR), 0.0) AS total_ar, "
    f"coalesce(sum(CASE WHEN LATE_PROB >= {_T} THEN DMBTR END), 0.0) AS at_risk_ar, "
    f"count_if(LATE_PROB >= {_T}) AS n_flagged, count(*) AS n_total, coalesce(avg(LATE_PROB), 0.0) AS avg_risk FROM scored)")),
    ["total_ar", "at_risk_ar", "risk_share", "avg_risk"]))
def p2_kpis(inp):
    """Headline KPIs: total / at-risk AR, share, flagged and total counts, mean risk."""
    return portfolio.kpis(inp.scored, inp.threshold)


@precision({'total_ar': 2, 'at_risk_ar': 2})
@register("p2_kpis_segment", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT total_ar, at_risk_ar, CASE WHEN total_ar > 0 THEN at_risk_ar / total_ar ELSE 0.0 END AS risk_share, "
    "n_flagged, n_total, avg_risk FROM (SELECT coalesce(sum(DMBTR), 0.0) AS total_ar, "
    f"coalesce(sum(CASE WHEN LATE_PROB >= {_T} THEN DMBTR END), 0.0) AS at_risk_ar, "
    f"count_if(LATE_PROB >= {_T}) AS n_flagged, count(*) AS n_total, coalesce(avg(LATE_PROB), 0.0) AS avg_risk "
    "FROM scored WHERE trim(REGION) = 'AMERICA' AND trim(INDUSTRY) = 'BUILDING')")),
    ["total_ar", "at_risk_ar", "risk_share", "avg_risk"]))
def p2_kpis_segment(inp):
    """KPIs for one region x industry slice (selector values are trimmed)."""
    return portfolio.kpis(inp.scored, inp.threshold, region=" AMERICA ", industry="BUILDING")


@register("p3_top_risk_queue", O.rounded(O.with_prefix(*O.SCORED, select=(
    f"SELECT {', '.join(portfolio.QUEUE_COLS)} FROM scored WHERE LATE_PROB >= {_T} "
    "ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20")), ["DMBTR", "LATE_PROB"]))
def p3_top_risk_queue(inp):
    """Top-20 flagged invoices by probability: the collections work queue."""
    return portfolio.top_risk_queue(inp.scored, inp.threshold)


@register("p4_filter_values", O.with_prefix(*O.SCORED, select=(
    "SELECT DISTINCT segment, value FROM (SELECT 'INDUSTRY' AS segment, trim(CAST(INDUSTRY AS VARCHAR)) AS value "
    "FROM scored UNION ALL SELECT 'REGION', trim(CAST(REGION AS VARCHAR)) FROM scored) WHERE value IS NOT NULL AND value <> ''")))
def p4_filter_values(inp):
    """Distinct trimmed, non-empty industry and region values."""
    return portfolio.filter_values(inp.scored)


@precision({'bin_left': 9})
@register("p5_risk_histogram", O.rounded(O.with_prefix(
    *O.SCORED, *O.hist_ctes("h", "SELECT CAST(LATE_PROB AS DOUBLE) AS x FROM scored", 40),
    select="SELECT bin, first(f + bin * ((l - f) / 40)) AS bin_left, count(*) AS n FROM h_b GROUP BY bin"),
    []))
def p5_risk_histogram(inp):
    """40 equal-width bins of the late probability."""
    return portfolio.histogram(inp.scored, "LATE_PROB", 40)


@register("p6_aging_top20", O.rounded(O.with_prefix(O.AGING_CTE, select=(
    "SELECT KUNNR, " + ", ".join(f"{O.q(b)} / CAST(1000 AS DOUBLE) AS {O.q(b)}" for b in AGING_BUCKETS)
    + ", TOTAL_OUTSTANDING / CAST(1000 AS DOUBLE) AS TOTAL_K FROM aging ORDER BY TOTAL_OUTSTANDING DESC, KUNNR LIMIT 20")),
    [*AGING_BUCKETS, "TOTAL_K"]))
def p6_aging_top20(inp):
    """Aging heatmap rows: 20 largest open balances, in thousands."""
    return portfolio.aging_top(inp.aging)


def _seg_bars_sql(seg):
    return O.rounded(O.with_prefix(*O.SCORED, select=(
        f"SELECT {seg} AS value, avg(LATE_PROB) AS mean_prob, count(*) AS n, CASE WHEN avg(LATE_PROB) > CAST(0.5 AS DOUBLE) "
        f"THEN 'high' WHEN avg(LATE_PROB) > CAST(0.3 AS DOUBLE) THEN 'medium' ELSE 'low' END AS color_class "
        f"FROM scored WHERE {seg} IS NOT NULL GROUP BY {seg}")), ["mean_prob"])


@register("p7_segment_bars_industry", _seg_bars_sql("INDUSTRY"))
def p7_segment_bars_industry(inp):
    """Mean risk and count per industry with colour class."""
    return portfolio.segment_bars(inp.scored, "INDUSTRY")


@register("p7_segment_bars_region", _seg_bars_sql("REGION"))
def p7_segment_bars_region(inp):
    """Mean risk and count per region with colour class."""
    return portfolio.segment_bars(inp.scored, "REGION")


@register("p8_late_rate_trend", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT CAST(year(BLDAT) AS VARCHAR) || 'Q' || CAST(quarter(BLDAT) AS VARCHAR) AS PERIOD, avg(LATE_FLAG) * 100 AS late_pct "
    "FROM scored WHERE BLDAT IS NOT NULL GROUP BY 1")), ["late_pct"]))
def p8_late_rate_trend(inp):
    """Portfolio late rate (%) per document quarter."""
    return portfolio.late_rate_trend(inp.scored)


@precision({'at_risk_ar': 2})
@register("p11_export_summary", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT count(*) AS n_export, coalesce(sum(DMBTR), 0.0) AS at_risk_ar, coalesce(avg(LATE_PROB), 0.0) AS avg_risk FROM "
    f"(SELECT * FROM scored WHERE LATE_PROB >= {_T} ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20)")),
    ["at_risk_ar", "avg_risk"]))
def p11_export_summary(inp):
    """Audit-export preview: invoices to export, their AR and mean risk."""
    return portfolio.export_summary(inp.scored, inp.threshold)


@precision({'total_ar': 2, 'open_ar': 2})
@register("p13_status_summary", O.rounded(O.with_prefix(select=(
    "SELECT count_if(STATUS = 'CLEARED') AS n_cleared, count_if(STATUS = 'OPEN') AS n_open, min(BLDAT) AS first_date, "
    "max(BLDAT) AS last_date, coalesce(sum(DMBTR), 0.0) AS total_ar, "
    "coalesce(sum(CASE WHEN STATUS = 'OPEN' THEN DMBTR END), 0.0) AS open_ar FROM invn")), ["total_ar", "open_ar"]))
def p13_status_summary(inp):
    """Invoice status counts, document date range, total and open AR."""
    return portfolio.status_summary(inp.invoices)


@register("p14_customer_mix", O.rounded(O.with_prefix(*O.EDA_CTES, select=(
    "SELECT 'RISK_TIER' AS dimension, RISK_TIER AS value, count(*) AS n, count(*) / (SELECT count(*) FROM cust_eda) AS share "
    "FROM cust_eda GROUP BY RISK_TIER UNION ALL SELECT 'INDUSTRY', INDUSTRY, count(*), "
    "count(*) / (SELECT count(*) FROM cust_eda) FROM cust_eda GROUP BY INDUSTRY")), ["share"]))
def p14_customer_mix(inp):
    """Customer counts and shares by risk tier and by industry."""
    c = inp.customers_eda
    return portfolio.value_shares(c, "RISK_TIER").unionByName(portfolio.value_shares(c, "INDUSTRY"))


@register("p15_credit_limit_by_tier", O.rounded(O.with_prefix(*O.EDA_CTES, select=(
    "SELECT RISK_TIER, count(KLIMK) AS n, min(KLIMK) AS min, quantile_cont(KLIMK, 0.25) AS q1, "
    "quantile_cont(KLIMK, 0.5) AS median, quantile_cont(KLIMK, 0.75) AS q3, max(KLIMK) AS max "
    "FROM cust_eda WHERE KLIMK IS NOT NULL GROUP BY RISK_TIER")), ["min", "q1", "median", "q3", "max"]))
def p15_credit_limit_by_tier(inp):
    """Five-number summary of the credit limit per customer tier (exact)."""
    return portfolio.five_number_summary(inp.customers_eda, "KLIMK", "RISK_TIER")


@register("p16_terms_by_tier", O.rounded(O.with_prefix(*O.EDA_CTES, select=(
    "SELECT ZTERM, " + ", ".join(
        f"count_if(RISK_TIER = '{t}') * CAST(100 AS DOUBLE) / count(*) AS {t}" for t in ("Low", "Medium", "High"))
    + " FROM cust_eda WHERE ZTERM IS NOT NULL GROUP BY ZTERM")), ["Low", "Medium", "High"]))
def p16_terms_by_tier(inp):
    """Payment-terms x tier crosstab, row percentages."""
    return portfolio.crosstab_row_pct(inp.customers_eda, "ZTERM", "RISK_TIER", ["Low", "Medium", "High"])


@precision({'bin_left': 9})
@register("p17_days_late_histogram", O.rounded(O.with_prefix(
    *O.hist_ctes("h", "SELECT least(greatest(DAYS_LATE, CAST(-10 AS DOUBLE)), CAST(60 AS DOUBLE)) AS x "
                 "FROM invn WHERE STATUS = 'CLEARED'", 40),
    select="SELECT bin, first(f + bin * ((l - f) / 40)) AS bin_left, count(*) AS n FROM h_b GROUP BY bin"),
    []))
def p17_days_late_histogram(inp):
    """Days-late distribution clipped to -10..60 in 40 bins (cleared invoices)."""
    cleared = inp.invoices.where(F.col("STATUS") == "CLEARED")
    return portfolio.histogram(cleared, "DAYS_LATE", 40, clip=(-10, 60))


@register("p18_late_rates", O.rounded(O.with_prefix(*O.EDA_CTES, "c AS (SELECT * FROM inv_eda WHERE STATUS = 'CLEARED')", select=(
    "SELECT 'RISK_TIER' AS dimension, RISK_TIER AS value, avg(LATE_FLAG) * 100 AS metric FROM c WHERE RISK_TIER IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'INDUSTRY', INDUSTRY, avg(LATE_FLAG) * 100 FROM c WHERE INDUSTRY IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'overall', 'late_rate_pct', avg(LATE_FLAG) * 100 FROM c "
    "UNION ALL SELECT 'overall', 'avg_days_when_late', avg(DAYS_LATE) FROM c WHERE DAYS_LATE > 0")), ["metric"]))
def p18_late_rates(inp):
    """Late rate by customer tier and industry, overall, and mean days late when late."""
    return portfolio.late_rates(inp.customer_totals_eda)


@register("p19_seeded_sample", O.rounded(O.with_prefix(*O.EDA_CTES, select=(
    "SELECT BELNR, DMBTR, DAYS_LATE, RISK_TIER FROM inv_eda WHERE STATUS = 'CLEARED' "
    "ORDER BY md5(CAST(BELNR AS VARCHAR) || '|42'), BELNR LIMIT 1000")), ["DMBTR", "DAYS_LATE"]))
def p19_seeded_sample(inp):
    """Seeded 1,000-row sample of cleared invoices (amount vs days late), by hashed key."""
    cleared = inp.invoices.where(F.col("STATUS") == "CLEARED").select("BELNR", "KUNNR", "DMBTR", "DAYS_LATE")
    sample = portfolio.seeded_sample(cleared, "BELNR", 1000, 42)  # the customer view joins the sample, not all rows
    return sample.join(inp.customers_eda.select("KUNNR", "RISK_TIER"), "KUNNR", "left").select("BELNR", "DMBTR", "DAYS_LATE", "RISK_TIER")


@precision({'total': 2})
@register("p20_aging_bucket_totals", O.rounded(O.with_prefix(
    O.AGING_CTE,
    "long AS (" + " UNION ALL ".join(f"SELECT '{b}' AS bucket, {O.q(b)} AS amount FROM aging" for b in AGING_BUCKETS) + ")",
    "tot AS (SELECT bucket, coalesce(sum(amount), 0.0) AS total FROM long GROUP BY bucket)",
    select="SELECT bucket, total, round_even(total / (SELECT sum(total) FROM tot) * 100, 1) AS pct FROM tot"),
    ["total", "pct"]))
def p20_aging_bucket_totals(inp):
    """Open AR per aging bucket and its share of the portfolio."""
    return portfolio.aging_bucket_totals(inp.aging)


@precision({'total_open': 2, 'total_overdue': 2})
@register("p20_aging_overview", O.rounded(O.with_prefix(O.AGING_CTE, O.AGING_EDA_CTE, select=(
    "SELECT coalesce(sum(TOTAL_OUTSTANDING), 0.0) AS total_open, coalesce(sum(OVERDUE_TOTAL), 0.0) AS total_overdue, "
    "avg(OVERDUE_PCT) AS avg_overdue_pct FROM aging_eda")), ["total_open", "total_overdue", "avg_overdue_pct"]))
def p20_aging_overview(inp):
    """Total open and overdue AR, mean overdue share per customer."""
    return portfolio.aging_overview(inp.aging_eda)


@precision({'top_total': 2})
@register("p21_top20_concentration", O.rounded(O.with_prefix(O.AGING_CTE, select=(
    "SELECT count(*) AS n_customers, sum(TOTAL_OUTSTANDING) AS top_total, "
    "sum(TOTAL_OUTSTANDING) / (SELECT sum(TOTAL_OUTSTANDING) FROM aging) * 100 AS top_share_pct FROM "
    "(SELECT * FROM aging ORDER BY TOTAL_OUTSTANDING DESC, KUNNR LIMIT 20)")), ["top_total", "top_share_pct"]))
def p21_top20_concentration(inp):
    """Share of open AR held by the 20 largest customers."""
    return portfolio.top_concentration(inp.aging)


@precision({'HSL': 2})
@register("p22_cash_by_period", O.rounded(O.with_prefix(O.GL_EDA_CTE, select=(
    "SELECT PERIOD, sum(HSL) AS HSL FROM gl_eda GROUP BY PERIOD")), ["HSL"]))
def p22_cash_by_period(inp):
    """Total GL cash position per period."""
    return portfolio.cash_by_period(inp.gl_eda)


@precision({'HSL': 2})
@register("p22_cash_by_account", O.rounded(O.with_prefix(O.GL_EDA_CTE, select=(
    "SELECT PERIOD, ACCT_NAME, sum(HSL) AS HSL FROM gl_eda GROUP BY PERIOD, ACCT_NAME")), ["HSL"]))
def p22_cash_by_account(inp):
    """GL cash position per period and account name."""
    return portfolio.cash_by_period(inp.gl_eda, by_account=True)


_FEATS = list(FEATURE_COLS)
_LONG_FS = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, LATE_FLAG FROM fs" for c in _FEATS)


@register("p23_null_counts", O.with_prefix(*O.FS_CTES, select=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count_if({c} IS NULL) AS n_null FROM fs" for c in _FEATS)))
def p23_null_counts(inp):
    """Null count per model feature in the feature store."""
    return portfolio.null_counts(inp.feature_store)


@register("p24_describe", O.rounded(O.with_prefix(*O.FS_CTES, f"long AS ({_LONG_FS})", select=(
    "SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
    "max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, "
    "quantile_cont(value, 0.75) AS p75 FROM long GROUP BY feature")),
    ["mean", "std", "min", "max", "p25", "p50", "p75"]))
def p24_describe(inp):
    """count / mean / std / min / quartiles / max per model feature (exact quartiles)."""
    return portfolio.describe(inp.feature_store)


_CORR_COLS = _FEATS + ["LATE_FLAG"]


def _corr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i:]:
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM fs")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FROM fs")
    return " UNION ALL ".join(parts)


@register("p25_correlation_matrix", O.rounded(O.with_prefix(*O.FS_CTES, select=_corr_sql()), ["corr"]))
def p25_correlation_matrix(inp):
    """Pearson correlation of the 12 features and the target, every ordered pair."""
    return portfolio.correlation_long(inp.feature_store, _CORR_COLS)


@register("p25_target_correlation", O.rounded(O.with_prefix(
    *O.FS_CTES,
    "tc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), LATE_FLAG) AS corr FROM fs" for c in _FEATS) + ")",
    select="SELECT feature, corr, row_number() OVER (ORDER BY abs(corr) DESC, feature) AS rank FROM tc"), ["corr"]))
def p25_target_correlation(inp):
    """Feature correlation with LATE_FLAG ranked by absolute value."""
    return portfolio.target_correlation(inp.feature_store)


@precision({"bin_left": 9})
@register("p26_class_distributions", O.rounded(O.with_prefix(
    *O.FS_CTES, f"long AS ({_LONG_FS})",
    "pct AS (SELECT feature, LATE_FLAG AS label, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99, "
    "count(*) AS NN FROM long WHERE value IS NOT NULL GROUP BY ALL)",
    """b AS (SELECT long.feature AS feature, pct.label AS label, NN,
      CASE WHEN p01 = p99 THEN p01 - CAST(0.5 AS DOUBLE) ELSE p01 END AS f,
      CASE WHEN p01 = p99 THEN p99 + CAST(0.5 AS DOUBLE) ELSE p99 END AS l,
      least(greatest(value, p01), p99) AS x
    FROM long JOIN pct ON long.feature = pct.feature AND long.LATE_FLAG = pct.label WHERE value IS NOT NULL)""",
    "bb AS (SELECT *, least(greatest(CAST(floor((x - f) * (CAST(30 AS DOUBLE) / (l - f))) AS INTEGER), 0), 29) AS bin FROM b)",
    select="SELECT feature, label, bin, first(f + bin * ((l - f) / 30)) AS bin_left, count(*) AS n, "
    "count(*) / (first(NN) * first((l - f) / 30)) AS density FROM bb GROUP BY feature, label, bin"),
    ["label", "density"]))
def p26_class_distributions(inp):
    """Per feature and class: 30-bin density over the 1st..99th percentile range."""
    return portfolio.class_distributions(inp.feature_store)


@register("p27_industry_risk", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT INDUSTRY, round_even(avg(LATE_PROB), 3) AS mean, round_even(stddev_samp(LATE_PROB), 3) AS std, "
    "count(*) AS count FROM scored WHERE INDUSTRY IS NOT NULL GROUP BY INDUSTRY")), ["mean", "std"]))
def p27_industry_risk(inp):
    """Mean / std / count of the late probability per industry."""
    return portfolio.segment_risk_stats(inp.scored, "INDUSTRY")


@register("p28_run_summary", O.rounded(O.with_prefix(O.AGING_CTE, select=(
    "SELECT (SELECT count(*) FROM cdim) AS n_customers, count(*) AS n_invoices, count_if(AUGDT IS NULL) AS n_open, "
    "count_if(AUGDT IS NOT NULL) AS n_cleared, coalesce(avg(CASE WHEN AUGDT IS NOT NULL THEN LATE_FLAG END), 0.0) AS late_rate, "
    "(SELECT count(*) FROM aging) AS n_aging_rows, (SELECT count(*) FROM gl) AS n_gl_rows FROM invn")), ["late_rate"]))
def p28_run_summary(inp):
    """Row counts of every table, open / cleared items and the late rate."""
    return portfolio.run_summary(inp.customers, inp.invoices, inp.aging, inp.gl_raw)


@register("p29_customer_risk_view", O.rounded(O.with_prefix(*O.EDA_CTES, select="SELECT * FROM cust_eda"),
                                             ["KLIMK", "CUSTOMER_LATE_RATE"]))
def p29_customer_risk_view(inp):
    """Customers with their whole-history late rate (missing = 0) and tier."""
    return inp.customers_eda


# ----------------------------------------------------------------------------------------------
# F18, N: amount buckets and normalisation outputs
# ----------------------------------------------------------------------------------------------


@register("f18_amount_bucket", O.rounded(O.with_prefix(
    "cl AS (SELECT BELNR, DMBTR FROM invn WHERE STATUS = 'CLEARED')",
    "e AS (SELECT quantile_cont(DMBTR, [0.2, 0.4, 0.6, 0.8]) AS q FROM cl)",
    select="SELECT BELNR, DMBTR, CASE WHEN DMBTR IS NULL THEN -1 ELSE "
    "CAST(len(list_filter(list_distinct(e.q), lambda b: b < DMBTR)) AS INTEGER) END AS AMOUNT_BUCKET FROM cl, e"),
    ["DMBTR"]))
def f18_amount_bucket(inp):
    """Quintile code (0..4) of the invoice amount over cleared invoices."""
    cleared = inp.invoices.where(F.col("STATUS") == "CLEARED").select("BELNR", "DMBTR")
    return features.amount_bucket(cleared)


@register("n3_invoice_status", O.rounded(O.with_prefix(select=(
    "SELECT BELNR, KUNNR, BLDAT, FAEDT, AUGDT, DMBTR, STATUS, DAYS_LATE, LATE_FLAG FROM invn")),
    ["DMBTR", "DAYS_LATE", "LATE_FLAG"]))
def n3_invoice_status(inp):
    """Typed invoice history with STATUS, DAYS_LATE and LATE_FLAG."""
    return inp.invoices.select("BELNR", "KUNNR", "BLDAT", "FAEDT", "AUGDT", "DMBTR", "STATUS", "DAYS_LATE", "LATE_FLAG")


def _code_case(col, mapping, default):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"coalesce(CASE CAST({col} AS VARCHAR) {whens} END, '{default}')"


@register("n1_customer_master", O.rounded(O.with_prefix(select=(
    f"SELECT KUNNR, ZTERM, TRY_CAST(KLIMK AS DOUBLE) AS KLIMK, {_code_case('BRSCH', INDUSTRY_MAP, INDUSTRY_DEFAULT)} AS INDUSTRY, "
    f"{_code_case('REGIO', REGION_MAP, REGION_DEFAULT)} AS REGION FROM cust")), ["KLIMK"]))
def n1_customer_master(inp):
    """ERP code path: BRSCH / REGIO codes mapped to labels (unknown codes -> defaults)."""
    return normalize.customer_master(inp.customers_raw.drop("INDUSTRY", "REGION"))


@register("n7_customer_segments", O.with_prefix(select=(
    f"SELECT KUNNR, arg_min(INDUSTRY, ord) AS INDUSTRY, arg_min(REGION, ord) AS REGION FROM ("
    f"SELECT KUNNR, {_code_case('BRSCH', INDUSTRY_MAP, INDUSTRY_DEFAULT)} AS INDUSTRY, "
    f"{_code_case('REGIO', REGION_MAP, REGION_DEFAULT)} AS REGION, "
    "row_number() OVER (PARTITION BY KUNNR ORDER BY ERDAT NULLS FIRST, BUKRS) AS ord FROM cust) GROUP BY KUNNR")))
def n7_customer_segments(inp):
    """One (INDUSTRY, REGION) row per customer, deterministic first row."""
    return normalize.customer_segments(inp.customers_raw.drop("INDUSTRY", "REGION"))


@precision({"HSL": 2})
@register("n6_gl_fiscper", O.with_prefix(select="SELECT RACCT, GJAHR, POPER, HSL, FISCPER FROM gln"))
def n6_gl_fiscper(inp):
    """GL balances with FISCPER (year + clipped 2-digit period)."""
    return inp.gl.select("RACCT", "GJAHR", "POPER", "HSL", "FISCPER")


@precision({"HSL": 2})
@register("n10_gl_eda_fields", O.with_prefix(O.GL_EDA_CTE, select="SELECT RACCT, GJAHR, POPER, HSL, PERIOD, ACCT_NAME FROM gl_eda"))
def n10_gl_eda_fields(inp):
    """GL rows with display PERIOD and account name."""
    return inp.gl_eda.select("RACCT", "GJAHR", "POPER", "HSL", "PERIOD", "ACCT_NAME")


@precision({"TOTAL_OUTSTANDING": 2, "OVERDUE_TOTAL": 2})
@register("n11_aging_eda_fields", O.rounded(O.with_prefix(O.AGING_CTE, O.AGING_EDA_CTE, select=(
    "SELECT KUNNR, TOTAL_OUTSTANDING, OVERDUE_TOTAL, OVERDUE_PCT FROM aging_eda")), ["OVERDUE_PCT"]))
def n11_aging_eda_fields(inp):
    """Aging rows with overdue total and overdue share."""
    return inp.aging_eda.select("KUNNR", "TOTAL_OUTSTANDING", "OVERDUE_TOTAL", "OVERDUE_PCT")


# ----------------------------------------------------------------------------------------------
# 2.8 M: monthly series, targets, eligibility, pooling
# ----------------------------------------------------------------------------------------------
from ..operators import monthly  # noqa: E402

_MONEY2 = {c: 2 for c in O.MONTHLY_MONEY}
_MONEY2["COLLECTIONS_ROLL3_STD"] = 2
_MONEY2["AVG_LATE_PROB"] = 9


@precision(_MONEY2)
@register("m12_monthly_all_slices", O.rounded(O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, select="SELECT * FROM monthly"),
                                              [c for c in O.MONTHLY_DOUBLES if c not in _MONEY2]))
def m12_monthly_all_slices(inp):
    """Monthly collection series of every slice: overall, per region, per industry, per pair."""
    return inp.monthly


@precision(_MONEY2)
@register("m12_monthly_portfolio", O.rounded(O.with_prefix(
    *O.SCORED, *O.MONTHLY_CTES, select="SELECT * FROM monthly WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1"),
    [c for c in O.MONTHLY_DOUBLES if c not in _MONEY2]))
def m12_monthly_portfolio(inp):
    """The overall (portfolio) monthly series with the 12-row minimum enforced."""
    return monthly.build_forecast_dataset(inp.monthly)


@register("m16_segment_summary", O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, select=(
    "SELECT segment, months, cleared_invoices, eligible_for_segment_model, "
    "CASE WHEN reason = '' THEN 'eligible' ELSE reason END AS reason, kept_for_pooling FROM ("
    "SELECT REGION AS segment, count(*) AS months, sum(N_INVOICES_CLEARED) AS cleared_invoices, "
    "count(*) >= 24 AND sum(N_INVOICES_CLEARED) >= 250 AS eligible_for_segment_model, "
    "concat_ws(',', CASE WHEN count(*) < 24 THEN 'months<24' END, "
    "CASE WHEN sum(N_INVOICES_CLEARED) < 250 THEN 'cleared_invoices<250' END) AS reason, "
    "count(*) >= 12 AS kept_for_pooling FROM monthly WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 GROUP BY REGION)")))
def m16_segment_summary(inp):
    """Per-region eligibility for a segment model (months >= 24, cleared >= 250)."""
    return monthly.segment_summary(inp.monthly)


_TARGETS_SQL = O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, f"""t AS (
  SELECT *, row_number() OVER ({O._W_SLICE}) AS rn, count(*) OVER (PARTITION BY ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY) AS nn,
    lead(ACTUAL_COLLECTIONS, 1) OVER ({O._W_SLICE}) AS t30, lead(ACTUAL_COLLECTIONS, 2) OVER ({O._W_SLICE}) AS t60,
    lead(ACTUAL_COLLECTIONS, 3) OVER ({O._W_SLICE}) AS t90 FROM monthly)""",
    """tl AS (SELECT *, 30 AS HORIZON_DAYS, t30 AS TARGET FROM t UNION ALL SELECT *, 60, t60 FROM t UNION ALL SELECT *, 90, t90 FROM t)""",
    select="SELECT ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY, COLLECT_MONTH, HORIZON_DAYS, TARGET, "
    "CASE WHEN rn <= floor(nn * 0.8) THEN 'train' ELSE 'test' END AS split FROM tl WHERE TARGET IS NOT NULL")


@precision({"TARGET": 2})
@register("m13_horizon_targets", _TARGETS_SQL)
def m13_horizon_targets(inp):
    """Targets h = 1, 2, 3 months ahead within each slice, with the 80 % time split."""
    t = monthly.horizon_targets(inp.monthly)
    return t.select(*monthly.SLICE, "COLLECT_MONTH", "HORIZON_DAYS", "TARGET", "split")


@register("m17_pooled_training_rows", O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, select=(
    "SELECT REGION, COLLECT_MONTH FROM monthly WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 AND REGION IN "
    "(SELECT REGION FROM monthly WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 GROUP BY REGION HAVING count(*) >= 12)")))
def m17_pooled_training_rows(inp):
    """Rows pooled for the global model: kept segment series (else the overall series)."""
    return monthly.pooled_dataset(inp.monthly).select("REGION", "COLLECT_MONTH")


# ----------------------------------------------------------------------------------------------
# 2.6 C: classifier on MLlib (model outputs: rows-only checks plus invariants in tests)
# ----------------------------------------------------------------------------------------------
from ..operators import classify  # noqa: E402


@register("c9_class_weight_hint", O.rounded(O.with_prefix(*O.FS_CTES, O.SPLIT_CTE, select=(
    "SELECT split, count(*) AS n_rows, CAST(sum(LATE_FLAG) AS BIGINT) AS n_late, avg(LATE_FLAG) AS late_share, "
    "round_even((1 - avg(LATE_FLAG)) / avg(LATE_FLAG), 1) AS scale_pos_weight FROM split GROUP BY split")),
    ["late_share", "scale_pos_weight"]))
def c9_class_weight_hint(inp):
    """Rows, late count, late share and suggested positive weight per split."""
    return classify.class_weight_hint(inp.split)


@register("c7_model_scores")
def c7_model_scores(inp):
    """Every feature-store invoice scored by the fitted, calibrated boosted trees."""
    return inp.model_scored.select("BELNR", "split", "LATE_FLAG", "LATE_PROB", "LATE_PRED", "RISK_LABEL")


@register("c4_model_summary")
def c4_model_summary(inp):
    """Fitted model: trees up to the best validation AUC, threshold, positive weight, calibration."""
    m = inp.classifier
    return inp.spark.createDataFrame(
        [(m.gbt.getNumTrees, float(m.threshold), float(m.positive_weight), m.calibrator is not None)],
        "n_trees int, threshold double, positive_weight double, is_calibrated boolean",
    ).withColumn("n_train_rows", inp.split.where(F.col("split") == "train").agg(F.count(F.lit(1))).scalar())


@register("c4_boosting_trace")
def c4_boosting_trace(inp):
    """Validation AUC of every fitted round of the boosted trees, and which rounds were kept."""
    return inp.classifier.trace_table()


@register("e1_e5_model_test_metrics")
def e1_e5_model_test_metrics(inp):
    """AUC-ROC, step AUC-PR, Brier and confusion counts of the fitted model on the test split."""
    test = inp.model_scored.where(F.col("split") == "test")
    rank = metrics.ranking_metrics(test)
    cm = metrics.confusion(test)
    return rank.select("*", *[cm.select(c).scalar().alias(c) for c in ("tn", "fp", "fn", "tp")])


@register("c3_cross_validation")
def c3_cross_validation(inp):
    """Mean AUC over 5 exactly stratified folds of the fitting rows."""
    cut = classify.validation_cut(inp.split.where(F.col("split") == "train").drop("split"))
    return inp.spark.createDataFrame([(inp.cv_auc,)], "cv_auc double").withColumn(
        "n_rows", cut.where(~F.col("is_val")).agg(F.count(F.lit(1))).scalar())


@register("c8_baselines")
def c8_baselines(inp):
    """Test AUC of a stratified random guess, logistic regression and the boosted trees."""
    train = inp.split.where(F.col("split") == "train").drop("split")
    test = inp.split.where(F.col("split") == "test").drop("split")
    return classify.baselines(train, test, inp.classifier)


# ----------------------------------------------------------------------------------------------
# 2.8 M15, M18-M22, P9-P11: quantile forecasts (model outputs: rows-only checks; stand-ins in standin.py)
# ----------------------------------------------------------------------------------------------
from ..operators import forecast  # noqa: E402


@register("m22_forecast_training_results")
def m22_forecast_training_results(inp):
    """Pinball loss per (model, horizon, quantile) on each slice's last 20 % of months."""
    return inp.forecaster.results


@register("m18_segment_models", O.with_prefix(*O.SCORED, *O.MONTHLY_CTES, select=(
    "SELECT segment, months, cleared_invoices, eligible_for_segment_model, kept_for_pooling, eligible_for_segment_model AS trained, "
    "CASE WHEN eligible_for_segment_model THEN 'trained' ELSE reason END AS reason FROM ("
    "SELECT REGION AS segment, count(*) AS months, sum(N_INVOICES_CLEARED) AS cleared_invoices, "
    "count(*) >= 24 AND sum(N_INVOICES_CLEARED) >= 250 AS eligible_for_segment_model, "
    "concat_ws(',', CASE WHEN count(*) < 24 THEN 'months<24' END, "
    "CASE WHEN sum(N_INVOICES_CLEARED) < 250 THEN 'cleared_invoices<250' END) AS reason, "
    "count(*) >= 12 AS kept_for_pooling FROM monthly WHERE ALL_REGION = 0 AND ALL_INDUSTRY = 1 GROUP BY REGION)")))
def m18_segment_models(inp):
    """Segment eligibility with the trained flag and reason per region."""
    return inp.forecaster.summary


@register("m15_boosted_models")
def m15_boosted_models(inp):
    """Kept rounds, leaves and test loss of every quantile model."""
    return inp.forecaster.rounds()


@register("m21_forecast_portfolio")
def m21_forecast_portfolio(inp):
    """30 / 60 / 90-day collection quantiles for the whole portfolio."""
    return forecast.generate_forecast(inp.forecaster, inp.monthly)


@register("m21_forecast_region")
def m21_forecast_region(inp):
    """Forecast of every region (segment model when eligible, else global + fallback), in one job."""
    return forecast.generate_forecasts(inp.forecaster, inp.monthly, [(r, None) for r in forecast.regions(inp.monthly)])


@precision({"collections_m": 9})
@register("p9_history_band", O.rounded(O.with_prefix(*O.SCORED, *O.MONTHLY_CTES,
    "h AS (SELECT COLLECT_MONTH, ACTUAL_COLLECTIONS / CAST(1000000 AS DOUBLE) AS cm FROM monthly "
    "WHERE ALL_REGION = 1 AND ALL_INDUSTRY = 1 ORDER BY COLLECT_MONTH DESC LIMIT 18)",
    """b AS (SELECT COLLECT_MONTH, cm,
      CASE WHEN count(cm) OVER (ORDER BY COLLECT_MONTH ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2
           THEN stddev_samp(cm) OVER (ORDER BY COLLECT_MONTH ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS s,
      stddev_samp(cm) OVER () AS alls FROM h)""",
    """c AS (SELECT COLLECT_MONTH, cm, coalesce(s, greatest(coalesce(alls * 0.25, 0.15), 0.15)) AS sd FROM b)""",
    select="SELECT COLLECT_MONTH, cm AS collections_m, sd AS band_std, cm + sd AS upper_m, greatest(cm - sd, 0.0) AS lower_m FROM c"),
    ["band_std", "upper_m", "lower_m"]))
def p9_history_band(inp):
    """Last 18 months of portfolio collections ($M) with a rolling variability band."""
    return forecast.history_band(monthly.collection_series(monthly.customer_months(inp.invoices)))


@register("p10_forecast_points")
def p10_forecast_points(inp):
    """Forecast chart points: last month + horizon days, quantiles in $M."""
    overall = monthly.select_slice(inp.monthly)
    return forecast.forecast_points(overall, forecast.generate_forecast(inp.forecaster, inp.monthly))


@register("p11_export_summary_with_forecast")
def p11_export_summary_with_forecast(inp):
    """Audit-export preview including the 30-day median forecast."""
    fc = forecast.generate_forecast(inp.forecaster, inp.monthly)
    return portfolio.export_summary(inp.model_scored, inp.classifier.threshold, fc)


# ----------------------------------------------------------------------------------------------
# 2.9 X: attributions, narratives, audit checks (model outputs: rows-only checks)
# ----------------------------------------------------------------------------------------------
from ..functions.narrative import narrative  # noqa: E402
from ..operators import attribution  # noqa: E402


def risk_report(inp):
    top, phi, _ = inp.report_attributions
    arr = attribution.phi_array(phi)
    rows = top.join(arr, attribution.line_keys(arr))
    return rows.withColumn("NARRATIVE", narrative(F.col("LATE_PROB"), inp.classifier.threshold, F.col("SHAP_VALUES")))


@register("x7_risk_report")
def x7_risk_report(inp):
    """Top-20 flagged invoices with attribution arrays and audit narratives."""
    return risk_report(inp).drop("split")


@register("x2_report_attributions")
def x2_report_attributions(inp):
    """Per-invoice, per-feature margin contributions with base and model margin (additive)."""
    _, phi, base = inp.report_attributions
    return phi.join(base, attribution.line_keys(phi))


@register("x3_global_importance")
def x3_global_importance(inp):
    """Mean |contribution| per feature over the whole portfolio, ranked, with the contributions' standard error."""
    phi, _ = inp.portfolio_attributions
    return attribution.with_error(attribution.global_importance(phi), phi)


@register("x4_waterfall")
def x4_waterfall(inp):
    """Top-8 drivers per reported invoice with value and direction."""
    top, phi, _ = inp.report_attributions
    return attribution.waterfall(phi, top)


@register("x8_contributions_by_tier")
def x8_contributions_by_tier(inp):
    """Mean contribution per (risk tier, feature)."""
    phi, _ = inp.portfolio_attributions
    return attribution.contributions_by_tier(phi, inp.feature_store)


@register("x9_dependence")
def x9_dependence(inp):
    """CUST_LATE_RATE contribution against its value, coloured by CUST_AVG_DAYS_LATE."""
    phi, _ = inp.portfolio_attributions
    return attribution.dependence(phi, inp.feature_store, "CUST_LATE_RATE", "CUST_AVG_DAYS_LATE")


@register("x10_extremes")
def x10_extremes(inp):
    """The single highest- and lowest-risk invoices."""
    return attribution.extremes(inp.model_scored).select("which", "BELNR", "KUNNR", "LATE_PROB", "RISK_TIER")


@register("x11_audit_checks")
def x11_audit_checks(inp):
    """Six explanation / calibration policy checks with PASS / FAIL / SKIP, and the contributions' standard error."""
    phi, _ = inp.portfolio_attributions
    return attribution.with_error(attribution.audit_checks(phi, inp.model_scored), phi)


@register("p12_report_invoice_table", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT BELNR AS Invoice, substr(CAST(KUNNR AS VARCHAR), 1, 12) AS Customer, INDUSTRY AS Industry, DMBTR AS Amount, "
    "FAEDT AS Due_Date, LATE_PROB AS Risk_Score, CASE WHEN LATE_PROB >= CAST(0.7 AS DOUBLE) THEN 'high' "
    "WHEN LATE_PROB >= CAST(0.5 AS DOUBLE) THEN 'elevated' ELSE 'normal' END AS Risk_Band FROM scored "
    f"WHERE LATE_PROB >= {_T} ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20")), ["Amount", "Risk_Score"]))
def p12_report_invoice_table(inp):
    """Audit-export invoice table (top 20 flagged) with the risk colour band."""
    return portfolio.report_invoice_table(portfolio.top_risk_queue(inp.scored, inp.threshold))


@register("p12_report_summary_table")
def p12_report_summary_table(inp):
    """Audit-export summary table on the fitted model's flagged invoices."""
    m = inp.classifier
    return portfolio.report_summary_table(portfolio.top_risk_queue(inp.model_scored, m.threshold), inp.cv_auc, m.threshold)


@register("p12_report_forecast_table")
def p12_report_forecast_table(inp):
    """Audit-export forecast table: horizon, quantiles and uncertainty."""
    fc = forecast.generate_forecast(inp.forecaster, inp.monthly)
    return fc.select("Horizon", "Lower_10pct", "Median_50pct", "Upper_90pct", "Uncertainty_Pct")


@register("x5_narrative_standin", O.narrative_sql())
def x5_narrative_standin(inp):
    """Audit narratives for the top-20 flagged invoices with deterministic stand-in contributions
    (each feature's position in its portfolio range, in [-1, 1]) - the text oracle for X5."""
    sc = inp.scored
    stats = sc.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in FEATURE_COLS],
                   *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in FEATURE_COLS])
    rng = stats.select(F.struct(*stats.columns)).scalar()
    phis = []
    for c in FEATURE_COLS:
        mn, mx = rng[f"mn_{c}"], rng[f"mx_{c}"]
        phis.append(F.when(mx > mn, (F.lit(2.0) * F.col(c).cast("double") - mn - mx) / (mx - mn)).otherwise(F.lit(0.0)))
    top = attribution.top_flagged(sc).withColumn("phi", F.array(*phis))
    return top.select("BELNR", narrative(F.col("LATE_PROB"), inp.threshold, F.col("phi")).alias("NARRATIVE"))


@register("x10_extremes_standin", O.rounded(O.with_prefix(*O.SCORED, select=(
    "SELECT * FROM (SELECT 'highest' AS which, BELNR, KUNNR, LATE_PROB, RISK_TIER FROM scored "
    "ORDER BY LATE_PROB DESC, BELNR LIMIT 1) UNION ALL SELECT * FROM (SELECT 'lowest', BELNR, KUNNR, LATE_PROB, "
    "RISK_TIER FROM scored ORDER BY LATE_PROB ASC, BELNR LIMIT 1)")), ["LATE_PROB"]))
def x10_extremes_standin(inp):
    """Highest- and lowest-risk invoice on the stand-in score (oracle for X10's selection)."""
    return attribution.extremes(inp.scored).select("which", "BELNR", "KUNNR", "LATE_PROB", "RISK_TIER")
