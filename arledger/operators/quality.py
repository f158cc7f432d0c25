"""Q1-Q10: declarative data-quality rules over the raw exports.

One output schema for every rule: (dataset, rule, col_name, n_bad, n_rows, detail). The scalar rules of
a table are one aggregate without keys. Values outside a code list are counted among the rows that have one
(a filter, so a clean table has none to group); the ``DETAIL_VALUES`` first ones are listed in the report, picked
before the shuffle (``invalid_values`` gives all of them as rows). Nothing runs while a report is built.

``observed`` measures the same rules as metrics of another action, such as the write of the loaded table
(``load_validated``): then they cost no scan, and invalid values are looked for only in tables that have some.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import AGING_BUCKETS, INDUSTRY_MAP, PAYMENT_TERMS, REGION_MAP
from ..functions.expressions import to_date, to_double

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType(), False),
        T.StructField("rule", T.StringType(), False),
        T.StructField("col_name", T.StringType(), True),
        T.StructField("n_bad", T.LongType(), True),
        T.StructField("n_rows", T.LongType(), True),
        T.StructField("detail", T.StringType(), True),
    ]
)


@dataclass
class TableRules:
    required: list[str]
    no_nulls: list[str]
    valid_values: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


# FIXED VALUES: rule parameters per raw table
RULES = {
    "customer_master": TableRules(
        required=["KUNNR", "BUKRS", "NAME1", "LAND1", "REGIO", "BRSCH", "ZTERM", "KLIMK", "ERDAT"],
        no_nulls=["KUNNR", "BUKRS", "NAME1", "LAND1", "ZTERM", "KLIMK"],
        valid_values={"BRSCH": list(INDUSTRY_MAP), "REGIO": list(REGION_MAP), "ZTERM": list(PAYMENT_TERMS)},
        ranges={"KLIMK": (1_000, 10_000_000)},
    ),
    "invoice_history": TableRules(
        required=["BELNR", "BUKRS", "GJAHR", "BUZEI", "KUNNR", "BLDAT", "BUDAT", "FAEDT", "DMBTR",
                  "WAERS", "SHKZG", "ZTERM"],
        no_nulls=["BELNR", "BUKRS", "KUNNR", "BLDAT", "FAEDT", "DMBTR", "WAERS", "SHKZG", "ZTERM"],
        valid_values={"SHKZG": ["S"], "WAERS": ["USD"], "ZTERM": list(PAYMENT_TERMS)},
        ranges={"DMBTR": (0, 10_000_000)},
    ),
    "ar_aging": TableRules(
        required=["KUNNR", "BUKRS", "STIDA", *AGING_BUCKETS, "TOTAL_OUTSTANDING", "WAERS"],
        no_nulls=["KUNNR", "BUKRS", "STIDA", "TOTAL_OUTSTANDING"],
        valid_values={"WAERS": ["USD"]},
        ranges={"TOTAL_OUTSTANDING": (0, 1_000_000_000)},
    ),
    "gl_cash_positions": TableRules(
        required=["RBUKRS", "RACCT", "GJAHR", "POPER", "HSL", "WAERS"],
        no_nulls=["RBUKRS", "RACCT", "GJAHR", "POPER", "HSL", "WAERS"],
        valid_values={"WAERS": ["USD"]},
        ranges={"HSL": (0, 100_000_000)},
    ),
}


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def check_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Q1: missing required columns (schema only, no job)."""
    return [c for c in required if c not in df.columns]


def scalar_rules(dataset: str, df: DataFrame, rules: TableRules) -> tuple[list, list[tuple[str, str, str]]]:
    """Q2, Q4 (+Q6-Q8 for the tables they apply to): aggregates, and (rule, column, aggregate)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    items: list[tuple[str, str, str]] = []
    cols = set(df.columns)
    for c in rules.no_nulls:
        if c in cols:
            a = f"nulls__{c}"
            aggs.append(F.count_if(F.col(c).isNull()).alias(a))
            items.append(("not_null", c, a))
    for c, (lo, hi) in rules.ranges.items():
        if c not in cols:
            continue
        num = to_double(df, c)
        a1, a2 = f"nonnum__{c}", f"range__{c}"
        aggs.append(F.count_if(num.isNull() & F.col(c).isNotNull()).alias(a1))
        aggs.append(F.count_if((num < lo) | (num > hi)).alias(a2))
        items += [("non_numeric", c, a1), ("numeric_range", c, a2)]
    if dataset == "invoice_history" and {"BLDAT", "FAEDT", "AUGDT"} <= cols:
        # Q6: due before document, cleared before document (summed; a row may count twice)
        b, f, a = to_date(df, "BLDAT"), to_date(df, "FAEDT"), to_date(df, "AUGDT")
        aggs.append((F.count_if(f < b) + F.count_if(a.isNotNull() & (a < b))).alias("dates__"))
        items.append(("date_consistency", "BLDAT,FAEDT,AUGDT", "dates__"))
    if dataset == "ar_aging" and set(AGING_BUCKETS + ["TOTAL_OUTSTANDING"]) <= cols:
        # Q7: total vs bucket sum with isclose(atol=0.01, rtol=1e-5); plus negative cells
        total = F.coalesce(to_double(df, "TOTAL_OUTSTANDING"), F.lit(0.0))
        vals = [F.coalesce(to_double(df, b), F.lit(0.0)) for b in AGING_BUCKETS]
        s = vals[0]
        for v in vals[1:]:
            s = s + v
        mismatch = F.abs(total - s) > (F.lit(0.01) + F.lit(1e-5) * F.abs(s))
        neg = None
        for v in vals:
            cell = (v < 0).cast("int")
            neg = cell if neg is None else neg + cell
        aggs.append((F.count_if(mismatch) + F.sum(neg)).alias("aging__"))
        items.append(("aging_consistency", "TOTAL_OUTSTANDING", "aging__"))
    if dataset == "gl_cash_positions" and "POPER" in cols:
        # Q8: period outside 1..12 or not numeric
        p = to_double(df, "POPER")
        aggs.append(F.count_if(p.isNull() | (p < 1) | (p > 12)).alias("poper__"))
        items.append(("period_bounds", "POPER", "poper__"))
    if RECORD in cols:
        aggs.append(F.count_if(F.col(RECORD).isNotNull()).alias("malformed__"))
        items.append(("malformed_records", RECORD, "malformed__"))
    return aggs, items


#: Invalid values that the detail of a report row lists.
DETAIL_VALUES = 1_000


#: Column of a raw table that holds the text of records that couldn't be split into its fields (else null).
RECORD = "_MALFORMED"


def _invalid(df: DataFrame, rules: TableRules) -> dict[str, Column]:
    """Per column with a code list: whether a row's value is outside of it."""
    of = {c: F.col(c).cast("string") for c in rules.valid_values if c in df.columns}
    return {c: F.coalesce(v.isNotNull() & ~v.isin(*rules.valid_values[c]), F.lit(False)) for c, v in of.items()}


def invalid_values(dataset: str, df: DataFrame) -> DataFrame:
    """Q3 in full: (dataset, col_name, value, n_rows) of every distinct value outside the code lists."""
    bad = _invalid(df, RULES[dataset])
    if not bad:
        return df.sparkSession.createDataFrame([], "dataset string, col_name string, value string, n_rows long")
    some = None
    for cond in bad.values():
        some = cond if some is None else some | cond
    cells = [F.struct(F.when(cond, F.lit(c)).alias("c"), F.col(c).cast("string").alias("v")) for c, cond in bad.items()]
    long = df.where(some).select(F.explode(F.array(*cells)).alias("e")).where("e.c is not null")
    return long.groupBy(F.col("e.c").alias("col_name"), F.col("e.v").alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(dataset).alias("dataset"), "col_name", "value", "n_rows")


def _report_rows(dataset: str, total: DataFrame, items: list[tuple[str, str, str]], cols: list[str], values: DataFrame | None) -> DataFrame:
    """The rules' rows from one row of counts (``total``); Q3's counts and first values from the distinct ``values``
    (None: there are none) outside the lists of ``cols``."""
    cell = lambda rule, col, n: F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("col_name"), n.cast("long").alias("n_bad"))
    cells = [cell(rule, col, F.coalesce(F.col(a), F.lit(0))) for rule, col, a in items] + [cell("valid_values", c, F.lit(0)) for c in cols]
    rows = total.select(F.col("__n").cast("long").alias("n_rows"), F.explode(F.array(*cells)).alias("r"))
    rows = rows.select("r.rule", "r.col_name", "r.n_bad", "n_rows")
    if values is None or not cols:
        return rows.select(F.lit(dataset).alias("dataset"), "rule", "col_name", "n_bad", "n_rows", F.lit(None).cast("string").alias("detail"))
    first = F.row_number().over(Window.partitionBy("col_name").orderBy("value"))
    some = values.select("col_name", "value", first.alias("__r")).where(F.col("__r") <= DETAIL_VALUES)
    listed = some.groupBy("col_name").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("list"))
    counts = values.groupBy("col_name").agg(F.count(F.lit(1)).alias("n")).join(listed, "col_name")
    more = F.when(F.col("n") > DETAIL_VALUES, F.concat("list", F.lit(",... ("), F.col("n").cast("string"), F.lit(" values)"))).otherwise(F.col("list"))
    counts = counts.select(F.lit("valid_values").alias("rule"), "col_name", "n", more.alias("detail"))
    return rows.join(counts, ["rule", "col_name"], "left").select(
        F.lit(dataset).alias("dataset"), "rule", "col_name", F.coalesce("n", "n_bad").alias("n_bad"), "n_rows", "detail")


def _report(dataset: str, df: DataFrame, rules: TableRules) -> DataFrame:
    """Q2-Q4, Q6-Q8 of one table."""
    aggs, items = scalar_rules(dataset, df, rules)
    return _report_rows(dataset, df.agg(*aggs), items, list(_invalid(df, rules)), invalid_values(dataset, df))


def observed(dataset: str, df: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``df``, whose next action also measures Q2-Q4 and Q6-Q8, and a function that gives their report afterwards."""
    rules = RULES[dataset]
    spark = df.sparkSession
    missing = check_columns(df, rules.required)
    if missing:
        return df, lambda: _rows(spark, [(dataset, "required_columns", c, 1, None, "missing column") for c in missing])
    aggs, items = scalar_rules(dataset, df, rules)
    bad = _invalid(df, rules)
    seen = Observation(f"rules-{dataset}")
    names = ["__n", *(a for _, _, a in items)]
    out = df.observe(seen, *aggs, *[F.count_if(cond).alias(f"bad__{c}") for c, cond in bad.items()])

    def report() -> DataFrame:
        got = seen.get
        total = spark.createDataFrame([tuple(int(got.get(n) or 0) for n in names)], ", ".join(f"`{n}` long" for n in names))
        found = any(got.get(f"bad__{c}") for c in bad)
        return _report_rows(dataset, total, items, list(bad), invalid_values(dataset, df) if found else None)

    return out, report


def all_invalid_values(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Q3 in full over all tables that are there (``invalid_values`` of each)."""
    out = None
    for name in RULES:
        if tables.get(name) is not None:
            part = invalid_values(name, tables[name])
            out = part if out is None else out.unionByName(part)
    return out


def referential_integrity(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """Q5: number of distinct invoice customers missing from the master (anti join on keys)."""
    inv_keys = invoices.select(F.col("KUNNR").cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()
    master = customers.select(F.col("KUNNR").cast("string").alias("k")).distinct()
    orphans = inv_keys.join(master, "k", "left_anti").select(F.lit(1).alias("_o"), F.lit(0).alias("_r"))
    rows = invoices.select(F.lit(0).alias("_o"), F.lit(1).alias("_r"))
    return orphans.unionByName(rows).agg(
        F.sum("_o").alias("n_bad"), F.sum("_r").alias("n_rows")
    ).select(
        F.lit("invoice_history").alias("dataset"),
        F.lit("referential_integrity").alias("rule"),
        F.lit("KUNNR").alias("col_name"),
        F.coalesce(F.col("n_bad"), F.lit(0)).cast("long").alias("n_bad"),
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
        F.lit(None).cast("string").alias("detail"),
    )


def validate_table(dataset: str, df: DataFrame | None) -> DataFrame:
    spark = SparkSession.getActiveSession()
    rules = RULES[dataset]
    if df is None:
        return _rows(spark, [(dataset, "file_present", None, 1, 0, "missing input")])
    missing = check_columns(df, rules.required)
    if missing:
        # Q1 short-circuits the other rules of this table
        return _rows(spark, [(dataset, "required_columns", c, 1, None, "missing column") for c in missing])
    return _report(dataset, df, rules)


def validate_all(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Q10: every rule of every table (absent table = failed 'file_present' row), plus Q5 when
    both customer and invoice tables are usable. ``passed`` = n_bad == 0."""
    return _together({name: validate_table(name, tables.get(name)) for name in RULES}, tables)


def _together(reports: dict[str, DataFrame], tables: dict[str, DataFrame | None]) -> DataFrame:
    out = None
    for part in reports.values():
        out = part if out is None else out.unionByName(part)
    usable = {name: df for name, df in tables.items() if df is not None and not check_columns(df, RULES[name].required)}
    if "invoice_history" in usable and "customer_master" in usable:
        out = out.unionByName(referential_integrity(usable["invoice_history"], usable["customer_master"]))
    return out.withColumn("passed", F.coalesce(F.col("n_bad") == 0, F.lit(False)))


def load_validated(tables: dict[str, DataFrame | None], path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write every raw table that is there to ``path``/<name> and measure its rules during the write: the tables as
    scans of what was written, and the report of ``validate_all``."""
    spark = SparkSession.getActiveSession()
    reports, loaded = {}, {}
    for name in RULES:
        if tables.get(name) is None:
            reports[name] = validate_table(name, None)
            continue
        measured, report = observed(name, tables[name])
        measured.write.mode("overwrite").parquet(f"{path}/{name}")
        loaded[name] = spark.read.schema(measured.schema).parquet(f"{path}/{name}")
        reports[name] = report()
    return loaded, _together(reports, loaded)


def overall_passed(report: DataFrame) -> DataFrame:
    """Q10 overall flag: one row."""
    return report.agg(F.bool_and("passed").alias("all_passed"), F.count(F.lit(1)).alias("n_rules"))


def class_balance_report(invoices: DataFrame) -> DataFrame:
    """Q9: cleared, late, on-time counts and shares; imbalance warning when late share < 10 %."""
    a, f = to_date(invoices, "AUGDT"), to_date(invoices, "FAEDT")
    cleared = invoices.where(a.isNotNull())
    late = F.coalesce(F.datediff(a, f) > 0, F.lit(False))
    agg = cleared.agg(F.count(F.lit(1)).alias("n_cleared"), F.count_if(late).alias("n_late"))
    denom = F.greatest(F.col("n_cleared"), F.lit(1))
    return agg.select(
        "n_cleared",
        "n_late",
        (F.col("n_cleared") - F.col("n_late")).alias("n_on_time"),
        (F.col("n_late") / denom).alias("late_share"),
        ((F.col("n_cleared") - F.col("n_late")) / denom).alias("on_time_share"),
        ((F.col("n_late") / denom) < 0.1).alias("imbalance_warning"),
    )
