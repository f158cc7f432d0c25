"""Mixing sources to target weights by Poisson replication (operator 10), in DataFrame functions only.

Each source has a mean repetition rate: its target share of the mixture over its share of the rows. A hash of
the row and the seed gives a uniform number in [0, 1); inverting the Poisson distribution with that mean gives
the row's number of copies. Rows are unfolded by their counts and dealt out by another hash, in hash order
within each task: a global shuffle.

The distribution table of a source runs from 12 standard deviations (plus 25) below the mean to as many
above, past what the 52 bits of the uniform number can tell apart; no count is capped.

Defined results: a null source is a source of its own; a null id or text is hashed as an empty string; rows
equal in id and text get equal numbers of copies; empty texts are rows like others; an empty table gives an
empty one; other columns are carried along, whatever their names. A source that ``weights`` does not name
gets the weight 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Exponent of the default target: a source's weight is its share of the rows to this power.
TEMPERATURE_POWER = 0.5
DEFAULT_SEED = 7


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """One row per source: source, n, rate (mean copies of a row).

    ``weights`` are relative target weights (default: share of the rows to the power 0.5); ``epochs`` is the
    expected size of the mixture over the size of the table.
    """
    n = docs.groupBy(docs[source_col].alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE_POWER))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    n = n.withColumn("weight", weight)
    total = n.agg(F.sum("n").alias("all_rows"), F.sum("weight").alias("all_weight"))
    scalar = common.stored(n, "mix-sources")
    total = common.stored(total, "mix-total").first()
    rows, mass = float(total["all_rows"] or 0), float(total["all_weight"] or 0)
    rate = F.lit(0.0) if not mass else F.col("weight") / F.lit(mass) * F.lit(rows * epochs) / F.col("n")
    return scalar.select("source", "n", rate.alias("rate"))


def tables(rate: DataFrame) -> DataFrame:
    """One row per source of positive rate: source, least (the first count) and cdf, the distribution function there and on."""
    spread = F.lit(12.0) * F.sqrt("rate") + F.lit(25.0)
    steps = rate.where("rate > 0").withColumn("least", F.greatest(F.lit(0.0), F.floor(F.col("rate") - spread)).cast("long"))
    steps = steps.withColumn("k", F.explode(F.sequence("least", F.ceil(F.col("rate") + spread).cast("long"))))
    log_step = F.when(F.col("k") == F.col("least"), F.lit(0.0)).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    over = "OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)"
    steps = steps.withColumn("step", log_step).withColumn("log_mass", F.expr(f"sum(step) {over}"))
    steps = steps.withColumn("mass", F.exp(F.col("log_mass") - F.expr("max(log_mass) OVER (PARTITION BY source)")))
    steps = steps.withColumn("cdf", F.expr(f"sum(mass) {over}") / F.expr("sum(mass) OVER (PARTITION BY source)"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"])
    return steps.groupBy("source", "least").agg(listed.alias("cdf"))


def uniform(id_column: Column, text_column: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed, the id and the text."""
    nothing = F.lit("")
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(id_column.cast("string"), nothing), F.md5(F.coalesce(text_column, nothing).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = DEFAULT_SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = "copy") -> DataFrame:
    """The mixture: each row of ``docs`` as often as its count says, globally shuffled, with the number of
    the copy from 1 on in ``copy_col`` (None: without it; a column of that name is replaced).

    The table of the sources is joined as stored, without a hint: Spark broadcasts it only if its files are
    small, and else splits the hot source's rows in a sort-merge join. Text is shuffled once, copies of a row
    in different places.
    """
    table = common.stored(tables(rates(docs, weights, epochs, source_col)), "mix-tables")
    old = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    u = uniform(docs[id_col], docs[text_col], seed)
    rows = docs.select(*old, docs[source_col].alias("of"), u.alias("u")).join(table, F.col("of").eqNullSafe(F.col("source")))
    count = F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    rows = rows.withColumn("times", count).where("times > 0")
    # repeated rows are told apart by their partition, which a recomputed task keeps whatever the order of its rows
    place = F.xxhash64(F.lit(seed), F.col("u"), F.col("copy"), F.spark_partition_id())
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).withColumn("place", place)
    dealt = rows.repartition("place").sortWithinPartitions("place")
    kept = [i for i, c in enumerate(docs.columns) if copy_col is None or c.lower() != copy_col.lower()]
    return dealt.select(*[F.col(f"c{i}").alias(docs.columns[i]) for i in kept], *([] if copy_col is None else [F.col("copy").alias(copy_col)]))
