"""AR aging snapshot - open items bucketed by days overdue, pivoted per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGING_BUCKETS, COMPANY_CODE, CURRENCY
from ..functions.expressions import aging_bucket


def ar_aging(invoices: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Open invoices (AUGDT null) -> one row per customer with the six bucket sums, total, as of a
    date (default: the last document date of all invoices, a scalar of the same plan).

    Plan: a single hash aggregate keyed by KUNNR (map-side partial sums; a customer that holds
    a third of all rows costs one partial row per map task). The pivot is over a fixed literal
    list, so no extra job runs to discover bucket values. Empty input gives an empty frame
    with the full schema.
    """
    if as_of is None:
        as_of = invoices.agg(F.max("BLDAT")).scalar()
    # null customer keys form no group (pandas groupby semantics)
    open_items = invoices.filter(F.col("AUGDT").isNull() & F.col("KUNNR").isNotNull())
    overdue = F.datediff(as_of, F.col("FAEDT"))
    bucket = aging_bucket(overdue)
    sums = [
        F.coalesce(F.sum(F.when(bucket == b, F.col("DMBTR"))), F.lit(0.0)).alias(b) for b in AGING_BUCKETS
    ]
    agg = open_items.groupBy("KUNNR").agg(*sums)
    total = None
    for b in AGING_BUCKETS:
        total = F.col(f"`{b}`") if total is None else total + F.col(f"`{b}`")
    return agg.select(
        "KUNNR",
        F.lit(COMPANY_CODE).alias("BUKRS"),
        as_of.alias("STIDA"),
        *[F.col(f"`{b}`") for b in AGING_BUCKETS],
        total.alias("TOTAL_OUTSTANDING"),
        F.lit(CURRENCY).alias("WAERS"),
    )
