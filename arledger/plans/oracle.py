"""DuckDB reference SQL for the correctness gate.

The common prefix re-states the driver-table adapter (FIXTURES.md section 3) in SQL, so both
engines see the same invoices, customers and GL rows. Each query text is ``with_prefix(...)``.
"""

from __future__ import annotations

from ..constants import AGING_BUCKETS, INDUSTRY_MAP, PAYMENT_TERMS, REGION_MAP

_TERMS_CASE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'NT14' WHEN '2-HIGH' THEN 'NT30' " \
    "WHEN '3-MEDIUM' THEN 'NT45' WHEN '4-NOT SPECIFIED' THEN 'NT60' WHEN '5-LOW' THEN 'NT90' END"


def _days_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PAYMENT_TERMS.items())
    return f"CASE {col} {whens} END"


def _codes(known, other: str) -> str:
    """The ERP code that a customer's key picks: all known ones, an unknown one, none."""
    codes = ", ".join(f"'{c}'" for c in [*known, other]) + ", NULL"
    return f"([{codes}])[CAST(c_custkey % {len(known) + 2} + 1 AS INTEGER)]"


PREFIX = f"""
inv0 AS (
  SELECT o_orderkey AS BELNR, '1000' AS BUKRS, '001' AS BUZEI, o_custkey AS KUNNR,
         CAST(o_orderdate AS DATE) AS BLDAT, o_totalprice AS DMBTR, {_TERMS_CASE} AS ZTERM,
         o_orderstatus, o_orderkey, o_custkey
  FROM orders
),
inv1 AS (
  SELECT *, BLDAT + CAST({_days_case('ZTERM')} AS INTEGER) AS FAEDT FROM inv0
),
inv AS (
  SELECT BELNR, BUKRS, CAST(year(BLDAT) AS VARCHAR) AS GJAHR, BUZEI, KUNNR, 'DR' AS BLART,
         BLDAT, BLDAT AS BUDAT, FAEDT,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE FAEDT + CAST(greatest(o_custkey % 40 - 12 + o_orderkey % 17 - 8, -5) AS INTEGER) END AS AUGDT,
         DMBTR, 'USD' AS WAERS, 'S' AS SHKZG, ZTERM
  FROM inv1
),
invn AS (
  SELECT *,
         CASE WHEN AUGDT IS NULL THEN 'OPEN' ELSE 'CLEARED' END AS STATUS,
         CASE WHEN AUGDT IS NOT NULL THEN CAST(datediff('day', FAEDT, AUGDT) AS DOUBLE) END AS DAYS_LATE,
         CASE WHEN AUGDT IS NOT NULL THEN
              CAST(coalesce(datediff('day', FAEDT, AUGDT) > 0, false) AS DOUBLE) END AS LATE_FLAG
  FROM inv
),
cust AS (
  SELECT c_custkey AS KUNNR, '1000' AS BUKRS, c_name AS NAME1, n_name AS LAND1,
         {_codes(REGION_MAP, 'XX')} AS REGIO, {_codes(INDUSTRY_MAP, 'ZZ')} AS BRSCH, 'Z001' AS KTOKD,
         (['NT14','NT30','NT45','NT60','NT90'])[CAST(c_custkey % 5 + 1 AS INTEGER)] AS ZTERM,
         c_acctbal * 100 AS KLIMK, CAST(NULL AS DATE) AS ERDAT,
         c_mktsegment AS INDUSTRY, r_name AS REGION
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
cdim AS (SELECT KUNNR, ZTERM, KLIMK, INDUSTRY, REGION FROM cust),
gl AS (
  SELECT '1000' AS RBUKRS,
         CASE l_returnflag WHEN 'A' THEN '113100' WHEN 'N' THEN '113200' WHEN 'R' THEN '113300' END AS RACCT,
         CAST(year(CAST(l_shipdate AS DATE)) AS VARCHAR) AS GJAHR,
         lpad(CAST(month(CAST(l_shipdate AS DATE)) AS VARCHAR), 3, '0') AS POPER,
         sum(l_extendedprice) AS HSL, 'USD' AS WAERS
  FROM lineitem GROUP BY ALL
),
gln AS (
  SELECT *, substr(GJAHR, 1, 4) || lpad(CAST(least(greatest(coalesce(TRY_CAST(TRY_CAST(trim(POPER) AS DOUBLE) AS INTEGER), 1), 1), 12) AS VARCHAR), 2, '0') AS FISCPER
  FROM gl
)
"""

AS_OF = "(SELECT max(BLDAT) FROM inv)"


def with_prefix(*ctes: str, select: str) -> str:
    parts = [PREFIX.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select


def q(name: str) -> str:
    """Quote a column name for DuckDB."""
    return '"' + name.replace('"', '""') + '"'


AGING_CASE = (
    "CASE WHEN datediff('day', FAEDT, {asof}) <= 0 THEN 'Current' "
    "WHEN datediff('day', FAEDT, {asof}) <= 30 THEN '1-30 days' "
    "WHEN datediff('day', FAEDT, {asof}) <= 60 THEN '31-60 days' "
    "WHEN datediff('day', FAEDT, {asof}) <= 90 THEN '61-90 days' "
    "WHEN datediff('day', FAEDT, {asof}) <= 180 THEN '91-180 days' "
    "ELSE '180+ days' END"
).format(asof=AS_OF)

AGING_CTE = "aging AS (\n  SELECT KUNNR, '1000' AS BUKRS, {asof} AS STIDA, {sums}, {total} AS TOTAL_OUTSTANDING, 'USD' AS WAERS\n  FROM (SELECT *, {case} AS bucket FROM inv WHERE AUGDT IS NULL AND KUNNR IS NOT NULL) GROUP BY KUNNR\n)".format(
    asof=AS_OF,
    case=AGING_CASE,
    sums=", ".join(
        f"coalesce(sum(CASE WHEN bucket = '{b}' THEN DMBTR END), 0.0) AS {q(b)}" for b in AGING_BUCKETS
    ),
    total=" + ".join(
        f"coalesce(sum(CASE WHEN bucket = '{b}' THEN DMBTR END), 0.0)" for b in AGING_BUCKETS
    ),
)


def rounded(select_sql: str, double_cols: list[str], digits: int = 6, overrides: dict | None = None) -> str:
    """Wrap a SELECT so the listed DOUBLE columns are rounded like ``round_doubles``."""
    if not double_cols:
        return select_sql
    overrides = overrides or {}
    repl = ", ".join(f"round({q(c)}, {overrides.get(c, digits)}) AS {q(c)}" for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{select_sql}\n) AS _r"


# ---- feature store (F1-F27) ------------------------------------------------------------------
_W = "PARTITION BY KUNNR ORDER BY BLDAT, BELNR, BUZEI"
_WP = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

FS_CTES = [
    "clr AS (SELECT BELNR, BUZEI, KUNNR, BLDAT, FAEDT, DMBTR, ZTERM, STATUS, DAYS_LATE, LATE_FLAG "
    "FROM invn WHERE STATUS = 'CLEARED')",
    f"""hist AS (
  SELECT *,
    coalesce(avg(DAYS_LATE) OVER {_WP}, 0.0) AS CUST_AVG_DAYS_LATE,
    coalesce(avg(LATE_FLAG) OVER {_WP}, 0.0) AS CUST_LATE_RATE,
    CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS CUST_INVOICE_COUNT,
    coalesce(avg(DMBTR) OVER {_WP}, DMBTR) AS CUST_AVG_AMOUNT,
    coalesce(sum(DMBTR) OVER {_WP}, 0.0) AS CUST_TOTAL_EXPOSURE,
    avg(DAYS_LATE) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3,
    coalesce(max(DMBTR) OVER {_WP}, 0.0) AS CUST_MAX_INVOICE
  FROM clr
)""",
    """hist2 AS (
  SELECT *, coalesce(roll3, CUST_AVG_DAYS_LATE) AS CUST_ROLLING3_DAYS_LATE FROM hist
)""",
    f"""fs0 AS (
  SELECT h.*, d.INDUSTRY, d.REGION, d.KLIMK,
    CUST_ROLLING3_DAYS_LATE - CUST_AVG_DAYS_LATE AS CUST_LATE_TREND,
    coalesce(DMBTR / nullif(CUST_AVG_AMOUNT, 0), 1.0) AS CUST_AMOUNT_CONCENTRATION,
    CAST(month(BLDAT) AS INTEGER) AS INVOICE_MONTH,
    CAST(quarter(BLDAT) AS INTEGER) AS INVOICE_QUARTER,
    CAST(isodow(BLDAT) - 1 AS INTEGER) AS INVOICE_DOW,
    CAST(month(BLDAT) IN (3, 6, 9, 12) AS INTEGER) AS IS_QUARTER_END,
    CAST(day(BLDAT) >= 25 AS INTEGER) AS IS_MONTH_END,
    CAST(isodow(BLDAT) = 1 AS INTEGER) AS IS_MONDAY,
    CASE WHEN DMBTR > -1 THEN ln(1 + DMBTR) END AS LOG_AMOUNT,
    CAST({_days_case('ZTERM')} AS INTEGER) AS PAYMENT_DAYS_NUM,
    CAST(datediff('day', BLDAT, FAEDT) AS INTEGER) AS ACTUAL_TERM_DAYS,
    strftime(BLDAT, '%Y%m') AS FISCPER
  FROM hist2 h LEFT JOIN (SELECT KUNNR, INDUSTRY, REGION, KLIMK FROM cdim) d USING (KUNNR)
)""",
    "ind AS (SELECT INDUSTRY, CAST(row_number() OVER (ORDER BY INDUSTRY) - 1 AS INTEGER) AS INDUSTRY_CODE "
    "FROM (SELECT DISTINCT INDUSTRY FROM fs0 WHERE INDUSTRY IS NOT NULL))",
    "reg AS (SELECT REGION, CAST(row_number() OVER (ORDER BY REGION) - 1 AS INTEGER) AS REGION_CODE "
    "FROM (SELECT DISTINCT REGION FROM fs0 WHERE REGION IS NOT NULL))",
    "glagg AS (SELECT FISCPER, sum(HSL) AS TOTAL_CASH_POSITION FROM gln GROUP BY FISCPER)",
    """fs1 AS (
  SELECT fs0.*, coalesce(ind.INDUSTRY_CODE, -1) AS INDUSTRY_CODE, coalesce(reg.REGION_CODE, -1) AS REGION_CODE,
    ln(1 + coalesce(glagg.TOTAL_CASH_POSITION, 0.0)) AS LOG_CASH_POSITION,
    coalesce(DMBTR / nullif(KLIMK, 0), 0.0) AS INVOICE_TO_CREDIT_RATIO,
    CASE WHEN coalesce(CUST_LATE_RATE, 0.0) <= 0.2 THEN 'Low'
         WHEN coalesce(CUST_LATE_RATE, 0.0) <= 0.5 THEN 'Medium' ELSE 'High' END AS RISK_TIER
  FROM fs0 LEFT JOIN ind USING (INDUSTRY) LEFT JOIN reg USING (REGION) LEFT JOIN glagg USING (FISCPER)
)""",
]


def _fs_final() -> str:
    from ..constants import FEATURE_COLS, FEATURE_STORE_COLS

    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ["LATE_FLAG", *FEATURE_COLS])
    return f"fs AS (SELECT {', '.join(FEATURE_STORE_COLS)} FROM fs1 WHERE {notnull})"


FS_CTES.append(_fs_final())

FS_DOUBLES = [
    "DMBTR", "LOG_AMOUNT", "CUST_AVG_DAYS_LATE", "CUST_LATE_RATE", "CUST_AVG_AMOUNT",
    "CUST_ROLLING3_DAYS_LATE", "CUST_LATE_TREND", "CUST_MAX_INVOICE", "CUST_AMOUNT_CONCENTRATION",
    "CUST_TOTAL_EXPOSURE", "INVOICE_TO_CREDIT_RATIO", "LOG_CASH_POSITION", "LATE_FLAG", "DAYS_LATE",
]

SPLIT_CTE = """split AS (
  SELECT fs.*, CASE WHEN row_number() OVER (ORDER BY BLDAT, BELNR) <= floor(count(*) OVER () * 0.8)
                    THEN 'train' ELSE 'test' END AS split
  FROM fs
)"""


# ---- data-quality rules (Q1-Q10) ---------------------------------------------------------------
QUALITY_SOURCES = {"customer_master": "cust", "invoice_history": "inv", "ar_aging": "aging",
                   "gl_cash_positions": "gl"}


def _num(c: str) -> str:
    return f"TRY_CAST(trim(CAST({q(c)} AS VARCHAR)) AS DOUBLE)"


def quality_sql() -> str:
    from ..operators.quality import RULES

    parts = []
    for ds, rules in RULES.items():
        t = QUALITY_SOURCES[ds]
        n = f"(SELECT count(*) FROM {t})"
        scal = []
        for c in rules.no_nulls:
            scal.append(("not_null", c, f"count_if({q(c)} IS NULL)"))
        for c, (lo, hi) in rules.ranges.items():
            scal.append(("non_numeric", c, f"count_if({_num(c)} IS NULL AND {q(c)} IS NOT NULL)"))
            scal.append(("numeric_range", c, f"count_if({_num(c)} < {lo} OR {_num(c)} > {hi})"))
        if ds == "invoice_history":
            scal.append(("date_consistency", "BLDAT,FAEDT,AUGDT",
                         "count_if(FAEDT < BLDAT) + count_if(AUGDT IS NOT NULL AND AUGDT < BLDAT)"))
        if ds == "ar_aging":
            vals = [f"coalesce({_num(b)}, 0.0)" for b in AGING_BUCKETS]
            s = " + ".join(vals)
            neg = " + ".join(f"CAST({v} < 0 AS INTEGER)" for v in vals)
            scal.append(("aging_consistency", "TOTAL_OUTSTANDING",
                         f"count_if(abs(coalesce({_num('TOTAL_OUTSTANDING')}, 0.0) - ({s})) > 0.01 + 1e-5 * abs({s})) + sum({neg})"))
        if ds == "gl_cash_positions":
            scal.append(("period_bounds", "POPER",
                         f"count_if({_num('POPER')} IS NULL OR {_num('POPER')} < 1 OR {_num('POPER')} > 12)"))
        for rule, c, expr in scal:
            parts.append(
                f"SELECT '{ds}' AS dataset, '{rule}' AS rule, '{c}' AS col_name, CAST({expr} AS BIGINT) AS n_bad, "
                f"CAST({n} AS BIGINT) AS n_rows, CAST(NULL AS VARCHAR) AS detail FROM {t}"
            )
        for c, allowed in rules.valid_values.items():
            lst = ", ".join(f"'{a}'" for a in allowed)
            parts.append(
                f"SELECT '{ds}', 'valid_values', '{c}', CAST(count(*) AS BIGINT), CAST({n} AS BIGINT), "
                f"CASE WHEN count(*) > 0 THEN string_agg(v, ',' ORDER BY v) END "
                f"FROM (SELECT DISTINCT CAST({q(c)} AS VARCHAR) AS v FROM {t} "
                f"WHERE {q(c)} IS NOT NULL AND CAST({q(c)} AS VARCHAR) NOT IN ({lst}))"
            )
    parts.append(
        "SELECT 'invoice_history', 'referential_integrity', 'KUNNR', CAST(count(*) AS BIGINT), "
        "CAST((SELECT count(*) FROM inv) AS BIGINT), CAST(NULL AS VARCHAR) FROM "
        "(SELECT DISTINCT CAST(KUNNR AS VARCHAR) AS k FROM inv WHERE KUNNR IS NOT NULL) "
        "WHERE k NOT IN (SELECT CAST(KUNNR AS VARCHAR) FROM cust WHERE KUNNR IS NOT NULL)"
    )
    body = "\nUNION ALL\n".join(parts)
    return with_prefix(
        AGING_CTE,
        select=f"SELECT *, coalesce(n_bad = 0, false) AS passed FROM (\n{body}\n) AS rules",
    )


# ---- stand-in score and C7 ---------------------------------------------------------------------
def _standin_prior() -> str:
    from ..constants import STANDIN_PRIOR_RATE, STANDIN_PRIOR_WEIGHT

    return repr(float(STANDIN_PRIOR_RATE * STANDIN_PRIOR_WEIGHT))


def _threshold() -> str:
    from ..operators.scoring import DEFAULT_THRESHOLD

    return repr(DEFAULT_THRESHOLD)


def scored_cte(name: str = "scored", src: str = "fs") -> str:
    from ..constants import STANDIN_PRIOR_WEIGHT

    p = f"((CUST_LATE_RATE * CUST_INVOICE_COUNT + CAST({_standin_prior()} AS DOUBLE)) / (CUST_INVOICE_COUNT + {STANDIN_PRIOR_WEIGHT}))"
    return f"""{name} AS (
  SELECT * EXCLUDE (p), round_even(p, 4) AS LATE_PROB, CAST(p >= CAST({_threshold()} AS DOUBLE) AS INTEGER) AS LATE_PRED,
    CASE WHEN p > 0 AND p <= CAST(0.3 AS DOUBLE) THEN 'Low'
         WHEN p > CAST(0.3 AS DOUBLE) AND p <= CAST(0.6 AS DOUBLE) THEN 'Medium'
         WHEN p > CAST(0.6 AS DOUBLE) AND p <= 1 THEN 'High' END AS RISK_LABEL
  FROM (SELECT {src}.*, {p} AS p FROM {src})
)"""


SCORED = [*FS_CTES, scored_cte()]
SCORED_TEST = [*FS_CTES, SPLIT_CTE, scored_cte("scored_all", "split"),
               "scored_test AS (SELECT * FROM scored_all WHERE split = 'test')"]


# ---- evaluation (E1-E13, C6) -----------------------------------------------------------------------
def ranking_ctes(src: str, groups: list[str] | None = None, y: str = "LATE_FLAG", p: str = "LATE_PROB",
                 name: str = "rp") -> list[str]:
    g = ", ".join(groups or [])
    gsel = f"{g}, " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    return [
        f"{name}_st AS (SELECT {gsel}round_even({p}, 6) AS s, count_if({y} = 1) AS pos, count_if({y} = 0) AS neg "
        f"FROM {src} GROUP BY ALL)",
        f"""{name} AS (SELECT {gsel}s, pos, neg,
  coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N,
  sum(pos) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
FROM {name}_st)""",
    ]


AUC_SQL = ("CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (neg_below + neg * CAST(0.5 AS DOUBLE))) "
           "/ (max(P) * max(N)) END")
AP_SQL = "CASE WHEN max(P) > 0 THEN sum(pos * (tp / (tp + fp))) / max(P) END"


def float_list(values: list[float]) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"


def count_le_sql(values: list[float], x: str, strict: bool = False) -> str:
    op = "<" if strict else "<="
    return f"CAST(len(list_filter({float_list(values)}, lambda t: t {op} {x})) AS INTEGER)"


def grid_metrics_ctes(src: str, grid: list[float], name: str = "gm", y: str = "LATE_FLAG",
                      p: str = "LATE_PROB") -> list[str]:
    rows = ", ".join(f"({k + 1}, {k}, CAST({t!r} AS DOUBLE))" for k, t in enumerate(grid))
    return [
        f"{name}_b AS (SELECT {count_le_sql(grid, p)} AS g, count_if({y} = 1) AS pos, count_if({y} = 0) AS neg "
        f"FROM {src} GROUP BY 1)",
        f"{name}_tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM {name}_b)",
        f"{name}_grid AS (SELECT * FROM (VALUES {rows}) AS t(g, k, threshold))",
        f"""{name}_cum AS (
  SELECT k, threshold,
    sum(coalesce(pos, 0)) OVER (ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(coalesce(neg, 0)) OVER (ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
  FROM {name}_grid LEFT JOIN {name}_b USING (g))""",
        f"""{name} AS (
  SELECT k, threshold,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall,
    CASE WHEN tp + fp + P > 0 THEN 2 * tp / (tp + fp + P) ELSE 0.0 END AS f1,
    (tp + fp) / (P + N) AS flag_rate,
    P / (P + N) AS base_rate
  FROM {name}_cum, {name}_tot)""",
    ]


# ---- portfolio (P) ---------------------------------------------------------------------------------
def tier_sql(rate: str) -> str:
    return (f"CASE WHEN coalesce({rate}, 0.0) <= CAST(0.2 AS DOUBLE) THEN 'Low' "
            f"WHEN coalesce({rate}, 0.0) <= CAST(0.5 AS DOUBLE) THEN 'Medium' ELSE 'High' END")


EDA_CTES = [
    f"""cust_eda AS (
  SELECT c.*, coalesce(r.rate, 0.0) AS CUSTOMER_LATE_RATE, {tier_sql('coalesce(r.rate, 0.0)')} AS RISK_TIER
  FROM cdim c LEFT JOIN (SELECT KUNNR, avg(LATE_FLAG) AS rate FROM invn
                         WHERE STATUS = 'CLEARED' AND KUNNR IS NOT NULL GROUP BY KUNNR) r USING (KUNNR))""",
    "inv_eda AS (SELECT * FROM invn LEFT JOIN (SELECT KUNNR, INDUSTRY, REGION, RISK_TIER FROM cust_eda) USING (KUNNR))",
]

AGING_EDA_CTE = "aging_eda AS (SELECT *, {ot} AS OVERDUE_TOTAL, coalesce(({ot}) / nullif(TOTAL_OUTSTANDING, 0) * 100, 0.0) AS OVERDUE_PCT FROM aging)".format(
    ot=" + ".join(f"coalesce({q(b)}, 0.0)" for b in AGING_BUCKETS[1:])
)

GL_EDA_CTE = """gl_eda AS (
  SELECT *, strftime(make_date(CAST(substr(GJAHR, 1, 4) AS INTEGER),
      least(greatest(coalesce(TRY_CAST(TRY_CAST(trim(POPER) AS DOUBLE) AS INTEGER), 1), 1), 12), 1), '%Y-%m') AS PERIOD,
    coalesce(CASE RACCT WHEN '100000' THEN 'Petty Cash' WHEN '113100' THEN 'Bank Account - Operating'
                        WHEN '113200' THEN 'Bank Account - Payroll' WHEN '113300' THEN 'Bank Account - Collections' END,
             RACCT) AS ACCT_NAME
  FROM gl)"""


def hist_ctes(name: str, values_select: str, n_bins: int, groups: list[str] | None = None) -> list[str]:
    """Equal-width bins (numpy rules) over each group's [min, max]; ``values_select`` yields
    the group columns and ``x``."""
    g = groups or []
    gsel = "".join(f"{c}, " for c in g)
    gby = f"GROUP BY {', '.join(g)}" if g else ""
    using = f"USING ({', '.join(g)})" if g else "ON TRUE"
    return [
        f"{name}_v AS ({values_select})",
        f"""{name}_r AS (SELECT {gsel}CASE WHEN min(x) = max(x) THEN min(x) - CAST(0.5 AS DOUBLE) ELSE min(x) END AS f,
                 CASE WHEN min(x) = max(x) THEN max(x) + CAST(0.5 AS DOUBLE) ELSE max(x) END AS l, count(*) AS NN
          FROM {name}_v WHERE x IS NOT NULL {gby})""",
        f"""{name}_b AS (SELECT {gsel}least(greatest(CAST(floor((x - f) * (CAST({n_bins} AS DOUBLE) / (l - f))) AS INTEGER), 0), {n_bins - 1}) AS bin,
                 f, l, NN FROM {name}_v JOIN {name}_r {using} WHERE x IS NOT NULL)""",
    ]


# ---- monthly series (M1-M14, M16, M17) ----------------------------------------------------------------
def _slice_agg_sql(name: str, src: str, month_expr: str, aggs: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT COLLECT_MONTH, REGION, INDUSTRY, GROUPING(REGION) AS ALL_REGION, GROUPING(INDUSTRY) AS ALL_INDUSTRY, {aggs}
    FROM (SELECT *, {month_expr} AS COLLECT_MONTH FROM {src})
    GROUP BY GROUPING SETS ((COLLECT_MONTH), (COLLECT_MONTH, REGION), (COLLECT_MONTH, INDUSTRY), (COLLECT_MONTH, REGION, INDUSTRY)))
  WHERE (ALL_REGION = 1 OR REGION IS NOT NULL) AND (ALL_INDUSTRY = 1 OR INDUSTRY IS NOT NULL) AND COLLECT_MONTH IS NOT NULL)"""


_SLICE_ON = ("{a}.COLLECT_MONTH = {b}.COLLECT_MONTH AND {a}.ALL_REGION = {b}.ALL_REGION AND {a}.ALL_INDUSTRY = {b}.ALL_INDUSTRY "
             "AND {a}.REGION IS NOT DISTINCT FROM {b}.REGION AND {a}.INDUSTRY IS NOT DISTINCT FROM {b}.INDUSTRY")
_W_SLICE = "PARTITION BY ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY ORDER BY COLLECT_MONTH"

MONTHLY_CTES = [
    f"""invm0 AS (
  SELECT invn.*, d.INDUSTRY AS INDUSTRY_RAW, d.REGION AS REGION_RAW,
         coalesce(CASE WHEN t.rate IS NOT NULL THEN {tier_sql('t.rate')} END, 'Medium') AS RISK_TIER
  FROM invn LEFT JOIN (SELECT KUNNR, INDUSTRY, REGION FROM cdim) d USING (KUNNR)
  LEFT JOIN (SELECT KUNNR, avg(LATE_FLAG) AS rate FROM invn WHERE STATUS = 'CLEARED' AND KUNNR IS NOT NULL GROUP BY KUNNR) t
  USING (KUNNR))""",
    """invm AS (SELECT *, CASE WHEN trim(CAST(REGION_RAW AS VARCHAR)) <> '' THEN trim(CAST(REGION_RAW AS VARCHAR)) END AS REGION,
                      CASE WHEN trim(CAST(INDUSTRY_RAW AS VARCHAR)) <> '' THEN trim(CAST(INDUSTRY_RAW AS VARCHAR)) END AS INDUSTRY
             FROM invm0)""",
    """scm AS (SELECT BLDAT, LATE_PROB, CASE WHEN trim(CAST(REGION AS VARCHAR)) <> '' THEN trim(CAST(REGION AS VARCHAR)) END AS REGION,
                      CASE WHEN trim(CAST(INDUSTRY AS VARCHAR)) <> '' THEN trim(CAST(INDUSTRY AS VARCHAR)) END AS INDUSTRY
            FROM scored)""",
    _slice_agg_sql("coll", "(SELECT * FROM invm WHERE STATUS = 'CLEARED')", "strftime(AUGDT, '%Y-%m')",
                   "coalesce(sum(DMBTR), 0.0) AS ACTUAL_COLLECTIONS, count(BELNR) AS N_INVOICES_CLEARED, "
                   "avg(DAYS_LATE) AS AVG_DAYS_LATE, avg(LATE_FLAG) AS LATE_RATE, "
                   "avg(CAST(RISK_TIER = 'High' AS DOUBLE)) AS HIGH_RISK_SHARE"),
    _slice_agg_sql("openm", "(SELECT * FROM invm WHERE STATUS = 'OPEN')", "strftime(BLDAT, '%Y-%m')",
                   "coalesce(sum(DMBTR), 0.0) AS OPEN_AR_TOTAL, CAST(count(BELNR) AS DOUBLE) AS N_OPEN_INVOICES"),
    _slice_agg_sql("riskm", "scm", "strftime(BLDAT, '%Y-%m')",
                   "CAST(sum(CAST(LATE_PROB AS DECIMAL(18, 4))) AS DOUBLE) / count(LATE_PROB) AS AVG_LATE_PROB"),
    "cash AS (SELECT strftime(strptime(FISCPER, '%Y%m'), '%Y-%m') AS COLLECT_MONTH, sum(HSL) AS OPENING_CASH FROM gln GROUP BY FISCPER)",
    f"""m0 AS (
  SELECT c.*, o.OPEN_AR_TOTAL, o.N_OPEN_INVOICES, g.OPENING_CASH, r.AVG_LATE_PROB
  FROM coll c LEFT JOIN openm o ON {_SLICE_ON.format(a='c', b='o')}
  LEFT JOIN cash g ON c.COLLECT_MONTH = g.COLLECT_MONTH
  LEFT JOIN riskm r ON {_SLICE_ON.format(a='c', b='r')})""",
    f"""m1 AS (
  SELECT ALL_REGION, ALL_INDUSTRY, REGION, INDUSTRY, COLLECT_MONTH, ACTUAL_COLLECTIONS, AVG_DAYS_LATE, LATE_RATE, HIGH_RISK_SHARE,
    coalesce(OPEN_AR_TOTAL, 0.0) AS OPEN_AR_TOTAL, coalesce(N_OPEN_INVOICES, 0.0) AS N_OPEN_INVOICES,
    coalesce(last_value(OPENING_CASH IGNORE NULLS) OVER ({_W_SLICE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS OPENING_CASH,
    coalesce(AVG_LATE_PROB, LATE_RATE) AS AVG_LATE_PROB, N_INVOICES_CLEARED
  FROM m0)""",
    f"""m2 AS (
  SELECT *, CAST(COLLECT_MONTH || '-01' AS DATE) AS PERIOD_DT,
    CAST(month(CAST(COLLECT_MONTH || '-01' AS DATE)) AS INTEGER) AS MONTH,
    CAST(quarter(CAST(COLLECT_MONTH || '-01' AS DATE)) AS INTEGER) AS QUARTER,
    CAST(month(CAST(COLLECT_MONTH || '-01' AS DATE)) IN (3, 6, 9, 12) AS INTEGER) AS IS_Q_END,
    sin(CAST(2 * pi() AS DOUBLE) * month(CAST(COLLECT_MONTH || '-01' AS DATE)) / 12) AS MONTH_SIN,
    cos(CAST(2 * pi() AS DOUBLE) * month(CAST(COLLECT_MONTH || '-01' AS DATE)) / 12) AS MONTH_COS,
    lag(ACTUAL_COLLECTIONS, 1) OVER ({_W_SLICE}) AS COLLECTIONS_LAG1,
    lag(ACTUAL_COLLECTIONS, 2) OVER ({_W_SLICE}) AS COLLECTIONS_LAG2,
    lag(ACTUAL_COLLECTIONS, 3) OVER ({_W_SLICE}) AS COLLECTIONS_LAG3,
    lag(LATE_RATE, 1) OVER ({_W_SLICE}) AS LATE_RATE_LAG1,
    lag(LATE_RATE, 2) OVER ({_W_SLICE}) AS LATE_RATE_LAG2,
    lag(LATE_RATE, 3) OVER ({_W_SLICE}) AS LATE_RATE_LAG3,
    CASE WHEN count(ACTUAL_COLLECTIONS) OVER ({_W_SLICE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
         THEN avg(ACTUAL_COLLECTIONS) OVER ({_W_SLICE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS COLLECTIONS_ROLL3_MEAN,
    CASE WHEN count(ACTUAL_COLLECTIONS) OVER ({_W_SLICE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
         THEN stddev_samp(ACTUAL_COLLECTIONS) OVER ({_W_SLICE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS COLLECTIONS_ROLL3_STD,
    ln(1 + ACTUAL_COLLECTIONS) AS LOG_ACTUAL_COLLECTIONS,
    ln(1 + coalesce(OPENING_CASH, 0.0)) AS LOG_OPENING_CASH,
    ln(1 + coalesce(OPEN_AR_TOTAL, 0.0)) AS LOG_OPEN_AR
  FROM m1)""",
]

MONTHLY_DATA_COLS = [
    "COLLECT_MONTH", "ACTUAL_COLLECTIONS", "AVG_DAYS_LATE", "LATE_RATE", "HIGH_RISK_SHARE", "OPEN_AR_TOTAL",
    "N_OPEN_INVOICES", "OPENING_CASH", "AVG_LATE_PROB", "N_INVOICES_CLEARED", "PERIOD_DT", "MONTH", "QUARTER",
    "IS_Q_END", "MONTH_SIN", "MONTH_COS", "COLLECTIONS_LAG1", "COLLECTIONS_LAG2", "COLLECTIONS_LAG3",
    "LATE_RATE_LAG1", "LATE_RATE_LAG2", "LATE_RATE_LAG3", "COLLECTIONS_ROLL3_MEAN", "COLLECTIONS_ROLL3_STD",
    "LOG_ACTUAL_COLLECTIONS", "LOG_OPENING_CASH", "LOG_OPEN_AR",
]
MONTHLY_CTES.append("monthly AS (SELECT * FROM m2 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MONTHLY_DATA_COLS) + ")")
MONTHLY_DOUBLES = [
    "ACTUAL_COLLECTIONS", "AVG_DAYS_LATE", "LATE_RATE", "HIGH_RISK_SHARE", "OPEN_AR_TOTAL", "N_OPEN_INVOICES",
    "OPENING_CASH", "AVG_LATE_PROB", "MONTH_SIN", "MONTH_COS", "COLLECTIONS_LAG1", "COLLECTIONS_LAG2",
    "COLLECTIONS_LAG3", "LATE_RATE_LAG1", "LATE_RATE_LAG2", "LATE_RATE_LAG3", "COLLECTIONS_ROLL3_MEAN",
    "COLLECTIONS_ROLL3_STD", "LOG_ACTUAL_COLLECTIONS", "LOG_OPENING_CASH", "LOG_OPEN_AR",
]
MONTHLY_MONEY = ["ACTUAL_COLLECTIONS", "OPEN_AR_TOTAL", "OPENING_CASH", "COLLECTIONS_LAG1", "COLLECTIONS_LAG2",
                 "COLLECTIONS_LAG3", "COLLECTIONS_ROLL3_MEAN"]


# ---- narrative (X5) on stand-in contributions ---------------------------------------------------------
def narrative_sql(ctes: tuple = (), phi_of=None, source: str = "top, rng") -> str:
    """X5 texts; ``phi_of(feature)`` is the SQL of a contribution (default: the place in its range)."""
    from ..constants import FEATURE_COLS, MONTH_ABBR

    feats = FEATURE_COLS
    months = "[" + ", ".join(f"'{m}'" for m in MONTH_ABBR) + "]"
    rng = ", ".join(f"min(CAST({c} AS DOUBLE)) AS mn_{c}, max(CAST({c} AS DOUBLE)) AS mx_{c}" for c in feats)
    phi = ", ".join(
        f"CASE WHEN mx_{c} > mn_{c} THEN (CAST(2.0 AS DOUBLE) * CAST({c} AS DOUBLE) - mn_{c} - mx_{c}) / (mx_{c} - mn_{c}) "
        f"ELSE 0.0 END AS phi_{c}" for c in feats)
    if phi_of is not None:
        phi = ", ".join(f"{phi_of(c)} AS phi_{c}" for c in feats)
    i0 = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
    t = {
        "CUST_AVG_DAYS_LATE": "'  • Customer payment history: averaging ' || " + i0.format(x="CUST_AVG_DAYS_LATE")
        + " || ' days late (' || CASE WHEN CUST_LATE_TREND > 2 THEN 'deteriorating' ELSE 'stable' END || ' trend)'",
        "CUST_LATE_RATE": "'  • Customer late rate: ' || " + i0.format(x="CUST_LATE_RATE * 100")
        + " || '% of historical invoices paid late'",
        "CUST_INVOICE_COUNT": "'  • Limited payment history: only ' || CAST(CAST(CUST_INVOICE_COUNT AS BIGINT) AS VARCHAR)"
        " || ' prior invoices (' || CASE WHEN CUST_INVOICE_COUNT < 5 THEN 'new relationship — insufficient data' "
        "ELSE 'early stage' END || ')'",
        "LOG_AMOUNT": "'  • Invoice size: $' || format('{:,}', CAST(round_even(DMBTR, 0) AS BIGINT)) || ' — ' || "
        "CASE WHEN CUST_AMOUNT_CONCENTRATION > 1.5 THEN 'significantly above' ELSE 'above' END || "
        "' customer average (requires additional approval steps)'",
        "IS_QUARTER_END": f"'  • Quarter-end timing: invoice issued in ' || {months}[least(greatest(CAST(INVOICE_MONTH AS INTEGER), 1), 12)]"
        " || ' — customer likely prioritising own close activities'",
        "CUST_AVG_AMOUNT": "'  • Invoice materially ' || CASE WHEN phi_CUST_AVG_AMOUNT > 0 THEN 'larger' ELSE 'smaller' END || "
        "' than this customer''s historical average — atypical transaction pattern'",
        "PAYMENT_DAYS_NUM": "'  • Extended payment terms (' || CAST(CAST(PAYMENT_DAYS_NUM AS BIGINT) AS VARCHAR) || "
        "' days) increase collection window and exposure duration'",
        "INDUSTRY_CODE": "'  • Industry payment culture: sector shows ' || CASE WHEN phi_INDUSTRY_CODE > 0 THEN 'above' ELSE 'below' END"
        " || '-average late payment rates in historical data'",
        "REGION_CODE": "'  • Regional factor: region shows ' || CASE WHEN phi_REGION_CODE > 0 THEN 'above' ELSE 'below' END"
        " || '-average payment punctuality historically'",
        "INVOICE_MONTH": "'  • Seasonal timing: month ' || CAST(CAST(INVOICE_MONTH AS BIGINT) AS VARCHAR) || ' historically shows ' || "
        "CASE WHEN phi_INVOICE_MONTH > 0 THEN 'lower' ELSE 'higher' END || ' collection rates'",
    }
    entries = ", ".join(
        f"{{'neg': -phi_{c}, 'pos': phi_{c}, 'i': {i}, 'name': '{c}', 'text': {t.get(c, 'CAST(NULL AS VARCHAR)')}}}"
        for i, c in enumerate(feats))
    level = (f"CASE WHEN LATE_PROB >= CAST(0.7 AS DOUBLE) THEN 'HIGH RISK' WHEN LATE_PROB >= CAST({_threshold()} AS DOUBLE) "
             "THEN 'ELEVATED RISK' ELSE 'MONITORED' END")
    action = (f"CASE WHEN LATE_PROB >= CAST(0.7 AS DOUBLE) THEN 'Immediate escalation to senior collections' "
              f"WHEN LATE_PROB >= CAST({_threshold()} AS DOUBLE) THEN 'Priority follow-up within 5 business days' "
              "ELSE 'Standard collections workflow' END")
    return with_prefix(
        *SCORED,
        f"rng AS (SELECT {rng} FROM scored)",
        f"top AS (SELECT * FROM scored WHERE LATE_PRED = 1 ORDER BY LATE_PROB DESC, BELNR ASC LIMIT 20)",
        *ctes,
        f"ph AS (SELECT top.*, {phi} FROM {source})",
        f"ent AS (SELECT *, [{entries}] AS arr, {level} AS lvl, {action} AS act FROM ph)",
        """parts AS (SELECT BELNR,
  ['[' || lvl || ']  Late probability: ' || CAST(CAST(round_even(LATE_PROB * 100, 0) AS BIGINT) AS VARCHAR) || '%',
   'Recommended action: ' || act, '', 'Key risk drivers:'] AS header,
  list_filter(list_transform(list_slice(list_sort(list_filter(arr, lambda e: e.pos > 0)), 1, 3), lambda e: e.text),
              lambda x: x IS NOT NULL) AS drivers,
  list_transform(list_slice(list_sort(list_transform(list_filter(arr, lambda e: e.pos < 0),
                 lambda e: {'v': e.pos, 'i': e.i, 'name': e.name})), 1, 2),
                 lambda e: '  ✓ ' || e.name || ': reduces risk by ' || printf('%.4f', round_even(abs(e.v), 4))) AS mitig,
  ['', 'Suggested actions:', '  1. ' || act] AS actions,
  list_filter([CASE WHEN CUST_LATE_RATE > 0.5 THEN '  2. Review credit limit — customer late on >50% of invoices' END,
               CASE WHEN CUST_INVOICE_COUNT < 5 THEN '  2. Request advance payment or shorter terms — limited history' END,
               CASE WHEN LATE_PROB >= CAST(0.7 AS DOUBLE) THEN '  3. Flag for CFO review if not resolved within 10 days' END],
              lambda x: x IS NOT NULL) AS extra
FROM ent)""",
        select="SELECT BELNR, array_to_string(list_concat(header, drivers, CASE WHEN len(mitig) > 0 THEN "
        "list_concat(['', 'Mitigating factors:'], mitig) ELSE [] END, actions, extra), chr(10)) AS NARRATIVE FROM parts",
    )
