"""Invoice feature store with prior-only customer history.

Customer history (F1-F9) is a running aggregate over each customer's cleared invoices ordered by
(BLDAT, BELNR, BUZEI). A plain ``Window.partitionBy("KUNNR")`` puts a customer's whole history in
one task; with one customer holding a third of all rows that task is the job. So the prefix is
computed in two levels:

1. rows are partitioned by (KUNNR, BLDAT): one window gives the in-day prior aggregates (the one
   shuffle and sort of whole rows; the day totals and last values come from two more scans of a few
   columns, reduced before their shuffles);
2. the day totals (one row per customer-day: bounded by the calendar, not by volume) get a
   running prefix over days per customer;
3. the day prefix is joined back on (KUNNR, BLDAT) - the fact side is already partitioned on
   exactly those keys, so only the small day table moves.

F6 (mean of the previous three rows, NULL positions included) uses in-day lags plus the last
three values of the previous days (lags on the day table), so the rolling window crosses day
boundaries without a wide frame and without array lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FEATURE_COLS, FEATURE_STORE_COLS, PAYMENT_TERMS, TARGET_COL, TEST_SIZE
from ..functions.expressions import lookup, risk_tier, safe_div, weekday_mon0
from .stats import exact_quantiles, running_counts

ORDER_TIEBREAK = ("BELNR", "BUZEI")
#: Document numbers of one block of a customer's day; leading characters that tell the blocks of text numbers apart.
BLOCK_DOCUMENTS, BLOCK_PREFIX = 1_000_000, 4


def document_block(df: DataFrame, ties: list[str]) -> Column:
    """The block of a document number, in the order of the numbers: so many whole numbers, or a prefix of a text
    (10-digit numbers: a million of them). It follows from the row alone, so no counts are needed beforehand."""
    if "BELNR" not in ties:
        return F.lit(0)
    if isinstance(df.schema["BELNR"].dataType, T.NumericType):
        return F.floor(F.col("BELNR") / F.lit(BLOCK_DOCUMENTS)).cast("long")
    return F.substring(F.col("BELNR").cast("string"), 1, BLOCK_PREFIX)


def _sum0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def asof_labels(cleared: DataFrame, key: str, date: str, known: str = "AUGDT") -> DataFrame:
    """Label state of a customer that was known before each document day: sums over the invoices
    cleared strictly earlier, and the days late of the last three of them (by clearing date, document
    date, key). One row per (customer, document day).

    Clearings are reduced to customer-days first; the as-of join is a union of clearing days and
    document days, of which the latter sort first within a day, and the last clearing state before.
    """
    ties = [c for c in ORDER_TIEBREAK if c in cleared.columns]
    events = cleared.where(F.col(known).isNotNull())
    dl, lf = F.col("DAYS_LATE"), F.col("LATE_FLAG")
    totals = events.groupBy(key, F.col(known).alias("_day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(dl).alias("sdl"), F.count(dl).alias("ndl"), F.sum(lf).alias("slf"), F.count(lf).alias("nlf"))
    newest = Window.partitionBy(key, known).orderBy(F.desc(date), *[F.desc(c) for c in ties])
    last3 = events.select(key, F.col(known).alias("_day"), dl.alias("_v"), F.row_number().over(newest).alias("_r")).where("_r <= 3")
    tails = last3.groupBy(key, "_day").agg(*[F.max(F.when(F.col("_r") == k, F.col("_v"))).alias(f"d{k}") for k in (1, 2, 3)])
    w = Window.partitionBy(key).orderBy("_day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    back = lambda c, k: F.lag(c, k).over(w)
    n = F.col("n")
    second = F.when(n >= 2, F.col("d2")).otherwise(back("d1", 1))
    third = F.when(n >= 3, F.col("d3")).when(n == 2, back("d1", 1)).when(back("n", 1) >= 2, back("d2", 1)).otherwise(back("d1", 2))
    state = F.struct(*[F.sum(c).over(upto).alias(c) for c in ("n", "sdl", "ndl", "slf", "nlf")],
                     F.col("d1").alias("v1"), second.alias("v2"), third.alias("v3"))
    clearings = totals.join(tails, [key, "_day"]).select(key, "_day", F.lit(1).alias("_kind"), state.alias("_state"))
    kind = clearings.schema["_state"].dataType
    days = cleared.select(key, F.col(date).alias("_day")).distinct().select(key, "_day", F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_state"))
    before = Window.partitionBy(key).orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = days.unionByName(clearings).withColumn("_known", F.last("_state", ignorenulls=True).over(before))
    return both.where("_kind = 0").select(key, F.col("_day").alias(date), *[F.col(f"_known.{c}").alias(f"_k_{c}") for c in kind.names])


def customer_history(cleared: DataFrame, key: str = "KUNNR", date: str = "BLDAT",
                     dim: DataFrame | None = None, asof: bool = False) -> DataFrame:
    """F1-F9 on cleared rows (scalar window functions only, all inside whole-stage codegen).
    By default the labels (days late, late flag) of all earlier documents count, as in the source,
    whether or not they were cleared by then. ``asof=True`` is free of that look-ahead: the averages
    and the rolling mean use only invoices cleared (AUGDT) before the document's day.
    Rows without customer or date have no history and are left out.
    Adds CUST_AVG_DAYS_LATE, CUST_LATE_RATE, CUST_INVOICE_COUNT,
    CUST_AVG_AMOUNT, CUST_TOTAL_EXPOSURE, CUST_ROLLING3_DAYS_LATE, CUST_MAX_INVOICE,
    CUST_LATE_TREND, CUST_AMOUNT_CONCENTRATION."""
    # NULL keys match nothing in the joins below: dropped before they meet in one task
    cleared = cleared.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    ties = [c for c in ORDER_TIEBREAK if c in cleared.columns]
    # a customer's day is cut into blocks of document numbers, in their order, so that a single day
    # with very many documents is spread over as many tasks as it has blocks; the level above
    # the rows is the block, and blocks follow each other as days do
    cleared = cleared.withColumn("_block", document_block(cleared, ties))
    unit = [key, date, "_block"]
    w_day = Window.partitionBy(*unit).orderBy(*ties)
    prior = w_day.rowsBetween(Window.unboundedPreceding, -1)
    dl, lf, amt = F.col("DAYS_LATE"), F.col("LATE_FLAG"), F.col("DMBTR")
    rn = F.col("_rn")

    # level 1: running (exclusive) aggregates inside the customer-day, one window operator;
    # this is the only shuffle of whole fact rows
    level1 = cleared.select(
        "*",
        F.row_number().over(w_day).alias("_rn"),
        F.sum(dl).over(prior).alias("_p_sdl"),
        F.count(dl).over(prior).alias("_p_ndl"),
        F.sum(lf).over(prior).alias("_p_slf"),
        F.count(lf).over(prior).alias("_p_nlf"),
        F.sum(amt).over(prior).alias("_p_samt"),
        F.count(amt).over(prior).alias("_p_namt"),
        F.max(amt).over(prior).alias("_p_mx"),
        *[F.lag(dl, k).over(w_day).alias(f"_l{k}") for k in (1, 2, 3)],
    )

    # the day table (one row per customer-day) comes from its own aggregates over the rows, not
    # from ``level1``: a second consumer of ``level1`` would re-run its scan and shuffle.
    # Totals: a hash aggregate (map-side partial, so a hot customer-day costs one partial row
    # per task). Last three values of the day: a row_number <= 3 filter, which Spark pre-limits
    # per task before the shuffle (WindowGroupLimit), then three conditional maxima.
    totals = cleared.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_d_n"),
        F.sum(dl).alias("_d_sdl"), F.count(dl).alias("_d_ndl"),
        F.sum(lf).alias("_d_slf"), F.count(lf).alias("_d_nlf"),
        F.sum(amt).alias("_d_samt"), F.count(amt).alias("_d_namt"),
        F.max(amt).alias("_d_mx"),
    )
    w_last = Window.partitionBy(*unit).orderBy(*[F.desc(c) for c in ties])
    last3 = cleared.select(*unit, dl.alias("_v"), F.row_number().over(w_last).alias("_r")).where(F.col("_r") <= 3)
    tails = last3.groupBy(*unit).agg(
        *[F.max(F.when(F.col("_r") == k, F.col("_v"))).alias(f"_d{k}") for k in (1, 2, 3)]
    )
    days = totals.join(tails, unit, "inner")
    n0 = lambda c: F.coalesce(c, F.lit(0))

    # level 2: prefix over the days of a customer (one row per customer-day)
    w_c = Window.partitionBy(key).orderBy(date, "_block")
    before = w_c.rowsBetween(Window.unboundedPreceding, -1)
    day_prefix = days.select(
        *unit,
        F.sum("_d_n").over(before).alias("_c_n"),
        F.sum("_d_sdl").over(before).alias("_c_sdl"),
        F.sum("_d_ndl").over(before).alias("_c_ndl"),
        F.sum("_d_slf").over(before).alias("_c_slf"),
        F.sum("_d_nlf").over(before).alias("_c_nlf"),
        F.sum("_d_samt").over(before).alias("_c_samt"),
        F.sum("_d_namt").over(before).alias("_c_namt"),
        F.max("_d_mx").over(before).alias("_c_mx"),
        # the three rows before this day, most recent first (c1, c2, c3): walk back over the
        # previous days' last values; every day has >= 1 row, so three days always suffice
        *_previous_three(w_c),
    )

    if asof:
        day_prefix = day_prefix.join(asof_labels(cleared, key, date), [key, date], "left")
    dim_cols = []
    if dim is not None:
        # customer attributes ride on the day table (keyed by customer already), so the fact
        # rows never need a second shuffle by customer for the dimension join
        dim_cols = [c for c in dim.columns if c != key]
        day_prefix = day_prefix.join(dim, key, "left")

    # level 3: join the day prefix back (the fact side is already partitioned on the keys). What is read more than once
    # is a column of its own: written out at every place, the last stage is one method of over 8,000 bytes, which the
    # JVM doesn't compile but interprets
    j = level1.join(day_prefix, unit, "inner")
    samt = F.when(F.col("_c_samt").isNull() & F.col("_p_samt").isNull(), F.lit(None)).otherwise(
        n0(F.col("_c_samt")) + n0(F.col("_p_samt"))
    )
    p = rn - 1  # earlier rows of the same day
    # rolling window of the previous three rows: in-day lags first, then the rows of earlier days
    w1 = F.when(p >= 1, F.col("_l1")).otherwise(F.col("_c1"))
    w2 = F.when(p >= 2, F.col("_l2")).when(p == 1, F.col("_c1")).otherwise(F.col("_c2"))
    w3 = F.when(p >= 3, F.col("_l3")).when(p == 2, F.col("_c1")).when(p == 1, F.col("_c2")).otherwise(F.col("_c3"))
    known = [c for c in j.columns if c.startswith("_k_")]
    parts = j.select(
        *[F.col(c) for c in cleared.columns if c != "_block"],
        *[F.col(c) for c in [*dim_cols, *known]],
        (n0(F.col("_c_n")) + p).alias("_have"),  # earlier rows of the customer
        *[(n0(F.col(f"_c_{c}")) + n0(F.col(f"_p_{c}"))).alias(f"_{c}") for c in ("sdl", "ndl", "slf", "nlf", "namt")],
        samt.alias("_samt"),
        F.greatest(F.col("_c_mx"), F.col("_p_mx")).alias("_mx"),
        w1.alias("_w1"), w2.alias("_w2"), w3.alias("_w3"),
    )
    state = "_k_" if asof else "_"
    mean = lambda total, n: F.coalesce(safe_div(F.col(state + total), F.col(state + n).cast("double")), F.lit(0.0))
    have = F.col("_have")
    slots = [(F.col(f"_w{i}"), have >= i) for i in (1, 2, 3)]
    if asof:
        slots = [(F.col(f"_k_v{i}"), F.lit(True)) for i in (1, 2, 3)]
    cnt = sum((e & v.isNotNull()).cast("int") for v, e in slots)
    tot = sum(F.when(e & v.isNotNull(), v).otherwise(F.lit(0.0)) for v, e in slots)

    base = parts.select(
        *[F.col(c) for c in cleared.columns if c != "_block"],
        *[F.col(c) for c in dim_cols],
        mean("sdl", "ndl").alias("CUST_AVG_DAYS_LATE"),
        mean("slf", "nlf").alias("CUST_LATE_RATE"),
        have.cast("int").alias("CUST_INVOICE_COUNT"),
        F.coalesce(F.when(F.col("_namt") > 0, F.col("_samt") / F.col("_namt")), amt).alias("CUST_AVG_AMOUNT"),
        F.coalesce(F.col("_samt"), F.lit(0.0)).alias("CUST_TOTAL_EXPOSURE"),
        cnt.alias("_cnt"), tot.alias("_tot"),
        F.coalesce(F.col("_mx"), F.lit(0.0)).alias("CUST_MAX_INVOICE"),
    ).withColumn("_roll", F.when(F.col("_cnt") > 0, F.col("_tot") / F.col("_cnt"))).drop("_cnt", "_tot")
    rolling = F.coalesce(F.col("_roll"), F.col("CUST_AVG_DAYS_LATE"))
    keep = [c for c in base.columns if c != "_roll"]
    return base.select(
        *keep,
        rolling.alias("CUST_ROLLING3_DAYS_LATE"),
        (rolling - F.col("CUST_AVG_DAYS_LATE")).alias("CUST_LATE_TREND"),
        safe_div(F.col("DMBTR"), F.col("CUST_AVG_AMOUNT"), 1.0).alias("CUST_AMOUNT_CONCENTRATION"),
    )


def _previous_three(w_c) -> list[Column]:
    """c1..c3: the last three rows before the current day, from lags over the day table."""
    n1, n2 = F.lag("_d_n", 1).over(w_c), F.lag("_d_n", 2).over(w_c)
    c1 = F.lag("_d1", 1).over(w_c)
    c2 = F.when(n1 >= 2, F.lag("_d2", 1).over(w_c)).otherwise(F.lag("_d1", 2).over(w_c))
    c3 = (
        F.when(n1 >= 3, F.lag("_d3", 1).over(w_c))
        .when(n1 == 2, F.lag("_d1", 2).over(w_c))
        .when(n2 >= 2, F.lag("_d2", 2).over(w_c))
        .otherwise(F.lag("_d1", 3).over(w_c))
    )
    return [c1.alias("_c1"), c2.alias("_c2"), c3.alias("_c3")]


def customer_history_single_window(cleared: DataFrame, key: str = "KUNNR") -> DataFrame:
    """Reference formulation of F1-F9 with one customer window (used by tests as brute force)."""
    ties = [c for c in ORDER_TIEBREAK if c in cleared.columns]
    w = Window.partitionBy(key).orderBy("BLDAT", *ties)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    dl, amt = F.col("DAYS_LATE"), F.col("DMBTR")
    out = cleared.select(
        "*",
        F.coalesce(F.avg(dl).over(prior), F.lit(0.0)).alias("CUST_AVG_DAYS_LATE"),
        F.coalesce(F.avg("LATE_FLAG").over(prior), F.lit(0.0)).alias("CUST_LATE_RATE"),
        (F.row_number().over(w) - 1).cast("int").alias("CUST_INVOICE_COUNT"),
        F.coalesce(F.avg(amt).over(prior), amt).alias("CUST_AVG_AMOUNT"),
        F.coalesce(F.sum(amt).over(prior), F.lit(0.0)).alias("CUST_TOTAL_EXPOSURE"),
        F.avg(dl).over(w.rowsBetween(-3, -1)).alias("_roll"),
        F.coalesce(F.max(amt).over(prior), F.lit(0.0)).alias("CUST_MAX_INVOICE"),
    )
    out = out.withColumn("CUST_ROLLING3_DAYS_LATE", F.coalesce(F.col("_roll"), F.col("CUST_AVG_DAYS_LATE")))
    out = out.withColumn("CUST_LATE_TREND", F.col("CUST_ROLLING3_DAYS_LATE") - F.col("CUST_AVG_DAYS_LATE"))
    out = out.withColumn(
        "CUST_AMOUNT_CONCENTRATION", safe_div(F.col("DMBTR"), F.col("CUST_AVG_AMOUNT"), 1.0)
    )
    return out.drop("_roll")


def invoice_features(df: DataFrame) -> DataFrame:
    """Calendar parts, flags, log amount, payment days, actual term days."""
    d = F.col("BLDAT")
    month = F.month(d)
    dom = F.dayofmonth(d)
    dow = weekday_mon0(d)
    return df.select(
        "*",
        month.alias("INVOICE_MONTH"),
        F.quarter(d).alias("INVOICE_QUARTER"),
        dow.alias("INVOICE_DOW"),
        dom.alias("INVOICE_DOM"),
        month.isin(3, 6, 9, 12).cast("int").alias("IS_QUARTER_END"),
        (dom >= 25).cast("int").alias("IS_MONTH_END"),
        (dow == 0).cast("int").alias("IS_MONDAY"),
        F.log1p("DMBTR").alias("LOG_AMOUNT"),
        lookup("ZTERM", PAYMENT_TERMS).cast("int").alias("PAYMENT_DAYS_NUM"),
        F.datediff("FAEDT", "BLDAT").alias("ACTUAL_TERM_DAYS"),
    )


def amount_bucket(df: DataFrame, col: str = "DMBTR") -> DataFrame:
    """quintile code 0..4 with linearly interpolated edges (right-closed, lowest included).

    The four edges come from the distributed exact quantile operator and are attached as a
    scalar subquery; duplicate edges collapse bins instead of failing. NULL amounts get -1.
    (Computed but not kept in the feature store, as in the reference.)
    """
    q = exact_quantiles(df, col, [0.2, 0.4, 0.6, 0.8])
    edges = [q.select(f"q{i}").scalar() for i in range(4)]  # one cached subquery, four scalars
    x = F.col(col)
    # edges are sorted, so a duplicate edge equals its predecessor: count distinct edges < x
    code = (edges[0] < x).cast("int")
    for i in range(1, 4):
        code = code + ((edges[i] < x) & (edges[i] != edges[i - 1])).cast("int")
    return df.withColumn("AMOUNT_BUCKET", F.when(x.isNull(), F.lit(-1)).otherwise(code).cast("int"))


#: Labels up to which a code mapping is written into the plan as literals.
LITERAL_LABELS = 1_000


def category_mapping(df: DataFrame, cols=("INDUSTRY", "REGION")) -> DataFrame:
    """(column, label, code) - the 0-based rank of every label among the sorted distinct
    labels of its column. Kept with a model, it gives new data the codes of the training data."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    labels = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (column, label)")).where("label is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("label"))
    return labels.select("column", "label", (rank - 1).cast("int").alias("code"))


def category_codes(df: DataFrame, cols=("INDUSTRY", "REGION"), labels_from: DataFrame | None = None,
                   mapping: DataFrame | None = None) -> DataFrame:
    """code columns by ``mapping`` (default: that of the labels in the data); NULL and labels
    that the mapping doesn't hold give -1. ``labels_from`` is a cheaper frame with the same label
    values. A mapping of at most ``LITERAL_LABELS`` labels (counted first) is written into the plan,
    so no join is needed; a larger one is joined, without a hint."""
    mapping = category_mapping(df if labels_from is None else labels_from, cols) if mapping is None else mapping
    rows = mapping.limit(LITERAL_LABELS + 1).collect()
    out = df
    for c in cols:
        if len(rows) <= LITERAL_LABELS:
            known = {r["label"]: r["code"] for r in rows if r["column"] == c}
            code = lookup(F.col(c).cast("string"), known).cast("int") if known else F.lit(None).cast("int")
            out = out.withColumn(f"{c}_CODE", F.coalesce(code, F.lit(-1)))
        else:
            of = mapping.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            joined = out.join(of, F.col(c).cast("string") == F.col("_label"), "left")
            out = joined.withColumn(f"{c}_CODE", F.coalesce("_code", F.lit(-1))).drop("_label", "_code")
    return out


def gl_context(df: DataFrame, gl: DataFrame) -> DataFrame:
    """GL total per FISCPER joined on the document month; LOG_CASH_POSITION =
    log1p(total or 0). The GL aggregate has one row per period (bounded by the calendar)."""
    gl_agg = gl.groupBy(F.col("FISCPER").cast("string").alias("FISCPER")).agg(
        F.sum("HSL").alias("TOTAL_CASH_POSITION")
    )
    out = df.select("*", F.date_format("BLDAT", "yyyyMM").alias("FISCPER")).join(F.broadcast(gl_agg), "FISCPER", "left")
    return out.select("*", F.log1p(F.coalesce(F.col("TOTAL_CASH_POSITION"), F.lit(0.0))).alias("LOG_CASH_POSITION"))


def _dedupe_dim(dim: DataFrame) -> DataFrame:
    from .normalize import dedupe_customers

    return dedupe_customers(dim)


def build_feature_store(customers: DataFrame, invoices: DataFrame, gl: DataFrame, asof: bool = False,
                        codes: DataFrame | None = None) -> DataFrame:
    """cleared invoices -> history -> customer dimension -> invoice features -> codes ->
    GL context -> credit ratio, tier -> drop incomplete rows (F27) -> 35 output columns.
    ``asof``: history without label look-ahead; ``codes``: the kept ``category_mapping`` of a model."""
    cleared = invoices.filter(F.col("STATUS") == "CLEARED").select(
        "BELNR", *[c for c in ("BUZEI",) if c in invoices.columns], *(["AUGDT"] if asof else []),
        "KUNNR", "BLDAT", "FAEDT", "DMBTR", "ZTERM", "STATUS", "DAYS_LATE", "LATE_FLAG",
    )
    # one row per customer (a duplicated master row must not duplicate invoices)
    dim = _dedupe_dim(customers.select("KUNNR", "INDUSTRY", "REGION", "KLIMK"))
    # the dimension joins the per-customer-day prefix table inside customer_history, not the
    # fact rows. No broadcast hint: Spark broadcasts it when its measured size is under the
    # threshold (static stats or AQE at runtime) and sort-merge joins it beyond that.
    out = customer_history(cleared, dim=dim, asof=asof)
    out = invoice_features(out)
    # labels present = labels of customers that have cleared invoices (semi join on keys)
    present = dim.join(cleared.select("KUNNR").distinct(), "KUNNR", "left_semi")
    out = category_codes(out, labels_from=present, mapping=codes)
    out = gl_context(out, gl)
    derived = {
        "INVOICE_TO_CREDIT_RATIO": safe_div(F.col("DMBTR"), F.col("KLIMK"), 0.0),
        "RISK_TIER": risk_tier(F.col("CUST_LATE_RATE")),
    }
    complete = None
    for c in [TARGET_COL, *FEATURE_COLS]:  # drop rows with a missing target or feature
        cond = F.col(c).isNotNull()
        complete = cond if complete is None else complete & cond
    return out.where(complete).select(*[derived[c].alias(c) if c in derived else F.col(c) for c in FEATURE_STORE_COLS])


def time_split(fs: DataFrame, test_size: float = TEST_SIZE, date: str = "BLDAT") -> DataFrame:
    """the first int(n*(1-test_size)) rows by date are 'train', the rest 'test'.

    The cut is found first, as a few scalars: the boundary day from daily counts (one row per
    date), then the boundary key (BELNR, BUZEI) from the running counts of that one day's keys.
    The split of every row is then a comparison with literals - no join, no rank of the rows -
    so all later reads agree, and date filters reach the scan. Rows that share the boundary key
    itself (repeated rows) are numbered by a hash of their columns; rows without a date are left
    out (they have no place in time).
    """
    ties = [c for c in ORDER_TIEBREAK if c in fs.columns]
    daily = fs.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    cut = F.floor(F.sum("_n").over(Window.partitionBy()) * (1 - test_size)).cast("long")
    days = daily.select(date, (upto - F.col("_n")).alias("before"), upto.alias("upto"), cut.alias("cut"))
    dated = fs.where(F.col(date).isNotNull())
    edge = days.where("before <= cut and upto > cut").first()  # the day of the first test row
    if edge is None:
        return dated.withColumn("split", F.lit("train"))
    day, quota = F.lit(edge[date]), edge["cut"] - edge["before"]
    late, same_day = F.col(date) > day, F.col(date) == day
    label = lambda train: F.when(train, F.lit("train")).otherwise(F.lit("test"))
    if quota == 0:
        return dated.withColumn("split", label(F.col(date) < day))
    key = F.struct(*[F.col(c) for c in ties])
    keys = running_counts(fs.where(same_day).select(*ties), ties)
    bound = keys.where(F.col("upto") >= quota).orderBy("upto").first()  # the last train row's key
    at = F.struct(*[F.lit(bound[c]).cast(fs.schema[c].dataType).alias(c) for c in ties])
    below = same_day & (key < at)
    rest = quota - (bound["upto"] - bound["n"])
    if rest == bound["n"]:
        return dated.withColumn("split", label((F.col(date) < day) | below | (same_day & key.eqNullSafe(at))))
    tied = dated.where(same_day & key.eqNullSafe(at))  # repeated rows of one key
    order = Window.partitionBy(F.lit(1)).orderBy(F.xxhash64(*[F.col(c) for c in fs.columns]))
    tied = tied.withColumn("_r", F.row_number().over(order)).withColumn("split", label(F.col("_r") <= rest)).drop("_r")
    others = dated.where(~(same_day & key.eqNullSafe(at)))
    return others.withColumn("split", label(~late & (~same_day | below))).unionByName(tied)


def feature_store_summary(fs: DataFrame) -> DataFrame:
    """rows, columns, late rate, tier shares (rounded 3)."""
    n_cols = len(fs.columns)
    return fs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_cols).alias("n_cols"),
        F.avg(TARGET_COL).alias("late_rate"),
        *[F.bround(F.avg((F.col("RISK_TIER") == t).cast("double")), 3).alias(f"share_{t.lower()}")
          for t in ("Low", "Medium", "High")],
    )


def split_summary(split_df: DataFrame, date: str = "BLDAT") -> DataFrame:
    """rows and date range per split."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("min_date"), F.max(date).alias("max_date")
    )
