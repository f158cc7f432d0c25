"""Declared schemas of the four ERP exports (never inferred: keys like BELNR look numeric)."""

from __future__ import annotations

from pyspark.sql import types as T

from ..constants import AGING_BUCKETS

S = T.StringType()
D = T.DoubleType()
DT = T.DateType()

CUSTOMER_MASTER = T.StructType(
    [
        T.StructField("KUNNR", S),
        T.StructField("BUKRS", S),
        T.StructField("NAME1", S),
        T.StructField("LAND1", S),
        T.StructField("REGIO", S),
        T.StructField("BRSCH", S),
        T.StructField("KTOKD", S),
        T.StructField("ZTERM", S),
        T.StructField("KLIMK", S),  # raw text: non-numeric values are a data-quality finding
        T.StructField("ERDAT", S),
    ]
)

INVOICE_HISTORY = T.StructType(
    [
        T.StructField("BELNR", S),
        T.StructField("BUKRS", S),
        T.StructField("GJAHR", S),
        T.StructField("BUZEI", S),
        T.StructField("KUNNR", S),
        T.StructField("BLART", S),
        T.StructField("BLDAT", S),
        T.StructField("BUDAT", S),
        T.StructField("FAEDT", S),
        T.StructField("AUGDT", S),
        T.StructField("DMBTR", S),
        T.StructField("WAERS", S),
        T.StructField("SHKZG", S),
        T.StructField("ZTERM", S),
    ]
)

AR_AGING = T.StructType(
    [T.StructField("KUNNR", S), T.StructField("BUKRS", S), T.StructField("STIDA", S)]
    + [T.StructField(b, S) for b in AGING_BUCKETS]
    + [T.StructField("TOTAL_OUTSTANDING", S), T.StructField("WAERS", S)]
)

GL_CASH_POSITIONS = T.StructType(
    [
        T.StructField("RBUKRS", S),
        T.StructField("RACCT", S),
        T.StructField("GJAHR", S),
        T.StructField("POPER", S),
        T.StructField("HSL", S),
        T.StructField("WAERS", S),
    ]
)

RAW_SCHEMAS = {
    "customer_master": CUSTOMER_MASTER,
    "invoice_history": INVOICE_HISTORY,
    "ar_aging": AR_AGING,
    "gl_cash_positions": GL_CASH_POSITIONS,
}
