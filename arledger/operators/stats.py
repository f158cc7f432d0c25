"""Distributed order statistics: running counts over distinct keys, exact interpolated quantiles.

``percentile`` keeps every distinct value of a group in one aggregation buffer; over a whole
column that buffer is the column. Here the values are counted first (combined before the shuffle,
so a value that holds most rows is one record per task), the distinct keys are range-partitioned
and **stored with their partition number**, and the running total of a key is its total within
the stored partition plus the sum of the partitions before it. Both parts read the same stored
rows: nothing depends on two exchanges sampling the same bounds.

Quantiles sort only what is near them: a mergeable sketch gives each quantile a bracket that surely holds it, one pass
counts the rows outside of all brackets, and only the values inside are counted, range-partitioned and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def running_counts(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per distinct ``order`` key: the key, ``n`` rows and ``upto``, the rows up to and
    including this key in the global order (ascending, NULL first)."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange(n_parts, *order).withColumn("_pid", F.spark_partition_id()), "running-counts")
    # one row per partition: bounded by spark.sql.shuffle.partitions
    totals = ranged.groupBy("_pid").agg(F.sum("n").alias("_pn"))
    offsets = totals.select("_pid", (F.sum("_pn").over(Window.orderBy("_pid")) - F.col("_pn")).alias("_off"))
    inside = F.sum("n").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_in", inside).join(F.broadcast(offsets), "_pid").select(
        *order, "n", (F.col("_off") + F.col("_in")).alias("upto")
    )


def _interp(lo_v: Column, hi_v: Column, frac: Column) -> Column:
    return lo_v + frac * (hi_v - lo_v)


#: Accuracy of the sketch (ranks are right to 1 / ACCURACY of a group), and the margin of a bracket in such units.
ACCURACY, MARGIN = 10_000, 4
#: Groups up to which their brackets are broadcast (they are counted first).
BROADCAST_GROUPS = 100_000


def _brackets(base: DataFrame, probs: list[float], groups: list[str]) -> DataFrame:
    """Per group _n and the ends _lo, _hi of each quantile's bracket, stored. In a group of more than 2 * ``ACCURACY`` rows
    the sketch's value at p - MARGIN / ACCURACY ranks below the quantile's rows and that at p + MARGIN / ACCURACY above;
    smaller groups are taken whole."""
    far = MARGIN / ACCURACY
    asked = [x for p in probs for x in (max(0.0, p - far), min(1.0, p + far))]
    sketch = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", asked, ACCURACY).alias("_b"))
    big = F.col("_n") > 2 * ACCURACY

    def ends(first: int, none: float) -> Column:
        edge = [0.0 if first == 0 else 1.0]  # at the ends of the range nothing is outside
        return F.array(*[F.when(big & F.lit(asked[2 * i + first] not in edge), F.col("_b")[2 * i + first]).otherwise(F.lit(none)) for i in range(len(probs))])

    return stored(sketch.select(*groups, "_n", ends(0, float("-inf")).alias("_lo"), ends(1, float("inf")).alias("_hi")), "quantile-brackets")


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], groups: list[str] | None = None, prefix: str = "q"
) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas default, Spark ``percentile``) per group.

    Output: group columns + one column ``{prefix}{i}`` per probability, plus ``n``. NULL/NaN
    values are ignored. Brackets of very many groups are joined without a hint, so any number of groups works.
    """
    groups = list(groups or [])
    x = F.col(value).cast("double")
    base = df.select(*groups, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    brackets = _brackets(base, probs, groups)
    if groups:
        same = None
        for g in groups:  # a NULL group is a group
            cond = F.col(g).eqNullSafe(F.col(f"_of_{g}"))
            same = cond if same is None else same & cond
        of = brackets.withColumnsRenamed({g: f"_of_{g}" for g in groups})
        near = base.join(F.broadcast(of) if brackets.count() <= BROADCAST_GROUPS else of, same)
    else:
        one = brackets.first()  # one row of numbers
        numbers = lambda a: F.array(*[F.lit(float(v)) for v in a])
        near = base.withColumns({"_n": F.lit(one["_n"]).cast("long"), "_lo": numbers(one["_lo"]), "_hi": numbers(one["_hi"])})
    k = range(len(probs))
    inside = F.lit(False)
    for i in k:
        inside = inside | ((F.col("_x") >= F.col("_lo")[i]) & (F.col("_x") <= F.col("_hi")[i]))
    # rows outside of all brackets, below each of them
    outside = near.where(~inside).groupBy(*groups).agg(*[F.count_if(F.col("_x") < F.col("_lo")[i]).alias(f"_d{i}") for i in k])
    counted = stored(running_counts(near.where(inside).select(*groups, "_x"), [*groups, "_x"]), "quantile-counts")
    sizes = counted.groupBy(*groups).agg(F.max("upto").alias("_end"), F.sum("n").alias("_kept"))
    if groups:
        per_group = sizes.join(outside.withColumnsRenamed({g: f"_of_{g}" for g in groups}), same, "left").drop(*[f"_of_{g}" for g in groups])
        per_group = per_group.join(of.drop("_lo", "_hi"), same).drop(*[f"_of_{g}" for g in groups])
        j = counted.join(per_group.withColumnsRenamed({g: f"_of_{g}" for g in groups}), same)
    else:
        below = outside.select(F.struct(*[f"_d{i}" for i in k])).scalar()
        j = counted.withColumns({"_n": F.lit(one["_n"]).cast("long"), "_end": F.lit(None).cast("long"), "_kept": F.lit(None).cast("long"), **{f"_d{i}": below[f"_d{i}"] for i in k}})
    # the value at 1-based rank r of a group is the kept one whose running count first reaches r, less the rows
    # that were left out below it
    last = F.col("upto") - F.coalesce(F.col("_end") - F.col("_kept"), F.lit(0))
    first = last - F.col("n") + 1
    n = F.col("_n")
    aggs = [F.first("_n").alias("n")]
    wanted = F.lit(False)
    for i, p in enumerate(probs):
        h = (n - 1) * F.lit(float(p))
        skipped = F.coalesce(F.col(f"_d{i}"), F.lit(0))
        lo, hi = F.floor(h) + 1 - skipped, F.ceil(h) + 1 - skipped
        at_lo, at_hi = (first <= lo) & (lo <= last), (first <= hi) & (hi <= last)
        wanted = wanted | at_lo | at_hi
        lo_v, hi_v = F.max(F.when(at_lo, F.col("_x"))), F.max(F.when(at_hi, F.col("_x")))
        aggs.append(_interp(lo_v, hi_v, F.first(h - F.floor(h))).alias(f"{prefix}{i}"))
    picked = j.where(wanted)  # at most 2 values per probability per group
    return picked.groupBy(*groups).agg(*aggs) if groups else picked.agg(*aggs)
