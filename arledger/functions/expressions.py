"""Column-expression helpers. Everything here is a built-in Catalyst expression (codegen, no UDF)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    AGING_BOUNDS,
    AGING_BUCKETS,
    MONTH_ABBR,
    RISK_LABEL_BOUNDS,
    TIER_LABELS,
    TIER_LOW_MAX,
    TIER_MEDIUM_MAX,
)


def lookup(col: Column | str, mapping: Mapping, default=None) -> Column:
    """Literal map lookup (``create_map``) with an optional default for misses and nulls."""
    col = F.col(col) if isinstance(col, str) else col
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    hit = F.create_map(*pairs)[col]
    return hit if default is None else F.coalesce(hit, F.lit(default))


def to_double(df: DataFrame | T.DataType, name: str) -> Column:
    """Numeric-or-null (pandas ``to_numeric(errors='coerce')``); NaN becomes NULL.
    ``df`` may be the column's data type (avoids re-analysing a plan per column)."""
    dtype = df if isinstance(df, T.DataType) else df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        v = F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)")
    else:
        v = F.col(name).cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def to_date(df: DataFrame | T.DataType, name: str) -> Column:
    """Date-or-null (pandas ``to_datetime(errors='coerce')``)."""
    dtype = df if isinstance(df, T.DataType) else df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return F.expr(f"try_to_date(trim(`{name}`))")
    return F.col(name).cast("date")


def safe_div(num: Column, den: Column, default=None) -> Column:
    """num / den with 0 and NULL denominators giving ``default`` (pandas ``replace(0, nan)``)."""
    q = F.try_divide(num, F.when(den != 0, den))
    return q if default is None else F.coalesce(q, F.lit(default))


def risk_tier(rate: Column) -> Column:
    """Late rate to tier: <=0.20 Low, <=0.50 Medium, else High; null rate counts as 0."""
    r = F.coalesce(rate, F.lit(0.0))
    return (
        F.when(r <= TIER_LOW_MAX, TIER_LABELS[0])
        .when(r <= TIER_MEDIUM_MAX, TIER_LABELS[1])
        .otherwise(TIER_LABELS[2])
    )


def risk_label(prob: Column) -> Column:
    """Right-closed bins (0,.3], (.3,.6], (.6,1]; outside (including 0) is NULL."""
    b = RISK_LABEL_BOUNDS
    return (
        F.when((prob > b[0]) & (prob <= b[1]), TIER_LABELS[0])
        .when((prob > b[1]) & (prob <= b[2]), TIER_LABELS[1])
        .when((prob > b[2]) & (prob <= b[3]), TIER_LABELS[2])
    )


def aging_bucket(days_overdue: Column) -> Column:
    """Days overdue to aging bucket; NULL falls into the last bucket."""
    expr = None
    for bound, label in zip(AGING_BOUNDS, AGING_BUCKETS):
        cond = days_overdue <= bound
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(AGING_BUCKETS[-1])


def weekday_mon0(d: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(d)


def month_name(month: Column) -> Column:
    """English month abbreviation, month clamped to 1..12."""
    arr = F.array(*[F.lit(m) for m in MONTH_ABBR])
    return F.element_at(arr, F.least(F.greatest(month, F.lit(1)), F.lit(12)))


def cyclic_month(month: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * month / F.lit(12)
    return F.sin(angle), F.cos(angle)


def quarter_label(d: Column) -> Column:
    """'2022Q1' style period label."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict | None = None) -> DataFrame:
    """Round every DOUBLE column (comparison precision for oracle checks); ``overrides`` maps
    column -> digits (money sums at cents, bin edges at 9 places)."""
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name), overrides.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
