"""Adapters from the driver's star-schema tables to the four ERP receivables exports.

The driver tables carry no due or clearing dates, so these are derived by integer arithmetic
that is identical in Spark and in the DuckDB oracle (see FIXTURES.md section 3). All adapters
are plain projections / aggregations over the whole tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    COMPANY_CODE,
    CURRENCY,
    INDUSTRY_MAP,
    PAYMENT_TERMS,
    PRIORITY_TERMS,
    REGION_MAP,
    RETURNFLAG_ACCOUNT,
)
from ..functions.expressions import lookup

TERM_CODES = list(PAYMENT_TERMS)
#: Codes that customers get in turn: all known ones, an unknown one, none.
INDUSTRY_CODES = [*INDUSTRY_MAP, "ZZ", None]
REGION_CODES = [*REGION_MAP, "XX", None]


_SCANS: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table (the scan object is reused within a session: the tables are
    read-only, and re-listing files and footers per query only costs planning time)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _SCANS[key]


def invoice_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order (BELNR = o_orderkey, unique), ERP columns typed."""
    o = table(spark, sf_dir, "orders")
    bldat = F.col("o_orderdate").cast("date")
    zterm = lookup("o_orderpriority", PRIORITY_TERMS)
    term_days = lookup(zterm, PAYMENT_TERMS)
    faedt = F.date_add(bldat, term_days)
    offset = F.greatest(
        F.col("o_custkey") % 40 - 12 + F.col("o_orderkey") % 17 - 8, F.lit(-5)
    ).cast("int")
    augdt = F.when(F.col("o_orderstatus") != "O", F.date_add(faedt, offset))
    return o.select(
        F.col("o_orderkey").alias("BELNR"),
        F.lit(COMPANY_CODE).alias("BUKRS"),
        F.year(bldat).cast("string").alias("GJAHR"),
        F.lit("001").alias("BUZEI"),
        F.col("o_custkey").alias("KUNNR"),
        F.lit("DR").alias("BLART"),
        bldat.alias("BLDAT"),
        bldat.alias("BUDAT"),
        faedt.alias("FAEDT"),
        augdt.alias("AUGDT"),
        F.col("o_totalprice").alias("DMBTR"),
        F.lit(CURRENCY).alias("WAERS"),
        F.lit("S").alias("SHKZG"),
        zterm.alias("ZTERM"),
    )


def customer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-shaped customer master. BRSCH / REGIO are ERP codes picked by the key (every known code,
    an unknown one and a missing one); INDUSTRY / REGION carry the driver's own labels for the
    analysis dimension :func:`customer_dim`."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    # nation and region are fixed 25- and 5-row tables: broadcasting them is bounded
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    terms = F.array(*[F.lit(t) for t in TERM_CODES])
    pick = lambda codes: F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("c_custkey") % len(codes) + 1).cast("int"))
    return c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").alias("KUNNR"),
        F.lit(COMPANY_CODE).alias("BUKRS"),
        F.col("c_name").alias("NAME1"),
        F.col("n_name").alias("LAND1"),
        pick(REGION_CODES).alias("REGIO"),
        pick(INDUSTRY_CODES).alias("BRSCH"),
        F.lit("Z001").alias("KTOKD"),
        F.element_at(terms, (F.col("c_custkey") % len(TERM_CODES) + 1).cast("int")).alias("ZTERM"),
        (F.col("c_acctbal") * 100).alias("KLIMK"),
        F.lit(None).cast("date").alias("ERDAT"),
        F.col("c_mktsegment").alias("INDUSTRY"),
        F.col("r_name").alias("REGION"),
    )


def customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis dimension (KUNNR, ZTERM, KLIMK, INDUSTRY, REGION) for the driver tables."""
    return customer_master(spark, sf_dir).select("KUNNR", "ZTERM", "KLIMK", "INDUSTRY", "REGION")


def gl_cash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GL balances per (period, account): sum of line prices by ship month and return flag."""
    li = table(spark, sf_dir, "lineitem")
    d = F.col("l_shipdate").cast("date")
    agg = li.groupBy(
        F.year(d).alias("_y"),
        F.month(d).alias("_m"),
        lookup("l_returnflag", RETURNFLAG_ACCOUNT).alias("RACCT"),
    ).agg(F.sum("l_extendedprice").alias("HSL"))
    return agg.select(
        F.lit(COMPANY_CODE).alias("RBUKRS"),
        "RACCT",
        F.col("_y").cast("string").alias("GJAHR"),
        F.lpad(F.col("_m").cast("string"), 3, "0").alias("POPER"),
        "HSL",
        F.lit(CURRENCY).alias("WAERS"),
    )
