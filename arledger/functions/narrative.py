"""Audit narrative as one built-in string expression per invoice (no UDF).

Inputs per row: the 12 feature columns, DMBTR, CUST_LATE_TREND, CUST_AMOUNT_CONCENTRATION, the
rounded probability and an array of 12 contributions in feature order. Drivers are the top three
positive contributions (ties keep feature order) that have a template; mitigants the two most
negative. Numbers are rounded half-even before formatting, as in the source formatting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FEATURE_COLS, HIGH_RISK_PROB
from .expressions import month_name

# FIXED VALUES: narrative wording (risk levels, actions, driver templates, section titles)
LEVEL_HIGH = "HIGH RISK"
LEVEL_ELEVATED = "ELEVATED RISK"
LEVEL_MONITORED = "MONITORED"
ACTION_HIGH = "Immediate escalation to senior collections"
ACTION_ELEVATED = "Priority follow-up within 5 business days"
ACTION_MONITORED = "Standard collections workflow"
TITLE_DRIVERS = "Key risk drivers:"
TITLE_MITIGANTS = "Mitigating factors:"
TITLE_ACTIONS = "Suggested actions:"
ACTION_CREDIT = "  2. Review credit limit — customer late on >50% of invoices"
ACTION_TERMS = "  2. Request advance payment or shorter terms — limited history"
ACTION_CFO = "  3. Flag for CFO review if not resolved within 10 days"


def _int_str(c: Column) -> Column:
    """Python ``f'{x:.0f}'``: half-even rounding of the binary value, no decimals."""
    return F.bround(c, 0).cast("long").cast("string")


def _templates(phi: Column) -> dict[str, Column]:
    """Driver line per feature (None: no template, the driver is skipped)."""
    c = F.col
    return {
        "CUST_AVG_DAYS_LATE": F.concat(
            F.lit("  • Customer payment history: averaging "), _int_str(c("CUST_AVG_DAYS_LATE")),
            F.lit(" days late ("), F.when(c("CUST_LATE_TREND") > 2, "deteriorating").otherwise("stable"), F.lit(" trend)")),
        "CUST_LATE_RATE": F.concat(
            F.lit("  • Customer late rate: "), _int_str(c("CUST_LATE_RATE") * 100),
            F.lit("% of historical invoices paid late")),
        "CUST_INVOICE_COUNT": F.concat(
            F.lit("  • Limited payment history: only "), c("CUST_INVOICE_COUNT").cast("long").cast("string"),
            F.lit(" prior invoices ("),
            F.when(c("CUST_INVOICE_COUNT") < 5, "new relationship — insufficient data").otherwise("early stage"),
            F.lit(")")),
        "LOG_AMOUNT": F.concat(
            F.lit("  • Invoice size: $"), F.format_number(F.bround(c("DMBTR"), 0), 0), F.lit(" — "),
            F.when(c("CUST_AMOUNT_CONCENTRATION") > 1.5, "significantly above").otherwise("above"),
            F.lit(" customer average (requires additional approval steps)")),
        "IS_QUARTER_END": F.concat(
            F.lit("  • Quarter-end timing: invoice issued in "), month_name(c("INVOICE_MONTH").cast("int")),
            F.lit(" — customer likely prioritising own close activities")),
        "CUST_AVG_AMOUNT": F.concat(
            F.lit("  • Invoice materially "), F.when(phi > 0, "larger").otherwise("smaller"),
            F.lit(" than this customer's historical average — atypical transaction pattern")),
        "PAYMENT_DAYS_NUM": F.concat(
            F.lit("  • Extended payment terms ("), c("PAYMENT_DAYS_NUM").cast("long").cast("string"),
            F.lit(" days) increase collection window and exposure duration")),
        "INDUSTRY_CODE": F.concat(
            F.lit("  • Industry payment culture: sector shows "), F.when(phi > 0, "above").otherwise("below"),
            F.lit("-average late payment rates in historical data")),
        "REGION_CODE": F.concat(
            F.lit("  • Regional factor: region shows "), F.when(phi > 0, "above").otherwise("below"),
            F.lit("-average payment punctuality historically")),
        "INVOICE_MONTH": F.concat(
            F.lit("  • Seasonal timing: month "), c("INVOICE_MONTH").cast("long").cast("string"),
            F.lit(" historically shows "), F.when(phi > 0, "lower").otherwise("higher"), F.lit(" collection rates")),
    }


def narrative(prob: Column, threshold: float, phi: Column, features: list[str] = FEATURE_COLS) -> Column:
    """The full multi-line narrative for one row."""
    level = F.when(prob >= HIGH_RISK_PROB, LEVEL_HIGH).when(prob >= threshold, LEVEL_ELEVATED).otherwise(LEVEL_MONITORED)
    action = F.when(prob >= HIGH_RISK_PROB, ACTION_HIGH).when(prob >= threshold, ACTION_ELEVATED).otherwise(ACTION_MONITORED)
    header = F.array(
        F.concat(F.lit("["), level, F.lit("]  Late probability: "), _int_str(prob * 100), F.lit("%")),
        F.concat(F.lit("Recommended action: "), action),
        F.lit(""),
        F.lit(TITLE_DRIVERS),
    )
    entries = []
    for i, f in enumerate(features):
        v = phi[i]
        text = _templates(v).get(f)
        entries.append(F.struct(
            (-v).alias("neg"), v.alias("pos"), F.lit(i).alias("i"), F.lit(f).alias("name"),
            (text if text is not None else F.lit(None).cast("string")).alias("text"),
        ))
    arr = F.array(*entries)
    # top three positive by value (stable: feature order), then the ones with a template
    positives = F.slice(F.array_sort(F.filter(arr, lambda e: e["pos"] > 0)), 1, 3)
    drivers = F.filter(F.transform(positives, lambda e: e["text"]), lambda t: t.isNotNull())
    negatives = F.slice(F.array_sort(F.transform(
        F.filter(arr, lambda e: e["pos"] < 0),
        lambda e: F.struct(e["pos"].alias("v"), e["i"].alias("i"), e["name"].alias("name")))), 1, 2)
    mitig_lines = F.transform(negatives, lambda e: F.concat(
        F.lit("  ✓ "), e["name"], F.lit(": reduces risk by "), F.format_string("%.4f", F.bround(F.abs(e["v"]), 4))))
    mitig = F.when(F.size(mitig_lines) > 0, F.concat(F.array(F.lit(""), F.lit(TITLE_MITIGANTS)), mitig_lines)) \
        .otherwise(F.array().cast("array<string>"))
    actions = F.array(F.lit(""), F.lit(TITLE_ACTIONS), F.concat(F.lit("  1. "), action))
    extra = F.filter(F.array(
        F.when(F.col("CUST_LATE_RATE") > 0.5, F.lit(ACTION_CREDIT)),
        F.when(F.col("CUST_INVOICE_COUNT") < 5, F.lit(ACTION_TERMS)),
        F.when(prob >= HIGH_RISK_PROB, F.lit(ACTION_CFO)),
    ), lambda t: t.isNotNull())
    return F.array_join(F.concat(header, drivers, mitig, actions, extra), "\n")
