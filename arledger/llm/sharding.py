"""Stable shards by jump consistent hashing (operator 9), in DataFrame functions only.

A row's 64-bit key is the first half of the MD5 of its id. The key seeds the 64-bit linear congruential
sequence of jump hashing, whose values give the shard counts at which the row would jump to a new last
shard; the last jump below the shard count is its shard. No ring table exists, the work per row is of the
order of log(shards) jumps, and one more shard takes rows only into itself.

The state is kept as two 32-bit halves and multiplied in 16-bit parts, as ANSI arithmetic must not overflow.

Defined results: a null id is keyed as the empty string (a shard like any other); a null text has no bytes;
equal rows get one shard and different slots; slots follow (key, id, size, checksum), so they depend on the
rows alone; an empty table gives an empty one. Only the named columns of the input are read by ``slots``;
``assign`` carries all others along and replaces a column that has the name of its result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the published algorithm: the multiplier 2862933555777941757 in 32-bit halves, and 2^31.
MULTIPLIER_HIGH, MULTIPLIER_LOW, TWO_31 = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF, 2147483648.0
MASK32 = 0xFFFFFFFF
BYTES_PER_ROW = 16
#: Rows that one window group of ``slots`` is meant to hold, and slots that one row is unfolded to at a time.
GROUP_ROWS, UNFOLD = 50_000, 4_096
#: Jumps of the first block.
JUMPS = 16


def key_halves(id_column: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the key."""
    digest = F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _times(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2^48 or more, for 32-bit x and factor, as two parts: low 32 bits and carry."""
    low, high = x * F.lit(factor & 0xFFFF), x * F.lit(factor >> 16)
    total = low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)
    return total.bitwiseAND(MASK32), F.shiftright(total, 32) + F.shiftright(high, 16)


def jump_shards(high: Column, low: Column, counts: list[int]) -> Column:
    """Struct of the shards (s0, s1, ...) of a key for each of ``counts``. The jumps are taken in blocks of ``JUMPS``, twice
    as many and so on, and a key that has passed the largest count skips the blocks that are left: a key takes about
    2 ln(count) jumps, and the steps of one block more at most."""
    most = max(counts)
    start = F.struct(high.alias("h"), low.alias("l"), F.lit(0).cast("long").alias("j"), *[F.lit(0).cast("long").alias(f"s{i}") for i in range(len(counts))])

    def step(state: Column, _: Column) -> Column:
        b = state["j"]
        low_part, carry = _times(state["l"], MULTIPLIER_LOW)
        cross = _times(state["l"], MULTIPLIER_HIGH)[0] + _times(state["h"], MULTIPLIER_LOW)[0]
        plus_one = low_part + F.lit(1)
        h = (carry + cross + F.shiftright(plus_one, 32)).bitwiseAND(MASK32)
        j = F.floor((b + F.lit(1)) * (F.lit(TWO_31) / (F.shiftright(h, 1) + F.lit(1)).cast("double"))).cast("long")
        seen = [F.when(b < F.lit(n), b).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)]
        moved = F.struct(h.alias("h"), plus_one.bitwiseAND(MASK32).alias("l"), j.alias("j"), *seen)
        return F.when(b >= F.lit(most), state).otherwise(moved)

    blocks, size = [], JUMPS
    while sum(blocks) < most:  # a jump moves by one shard at least
        blocks.append(min(size, most - sum(blocks)))
        size *= 2

    def block(state: Column, steps: Column) -> Column:
        return F.when(state["j"] >= F.lit(most), state).otherwise(F.aggregate(F.sequence(F.lit(1), steps), state, step))

    return F.aggregate(F.array(*[F.lit(n) for n in blocks]), start, block)


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """``df`` with each row's shard. Narrow: nothing is shuffled."""
    return common.plus(df, shard_col, jump_shards(*key_halves(df[id_col]), [shards])["s0"].cast("int"))


def slots(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: id, size, text_crc32, law, shard, gapless slot in the shard, and grown_shard.

    Text is read once and never shuffled. Rows that agree in all results but the slot are counted before the
    shuffle, so a repeated row is one record until its slots are unfolded, a few thousand at a time. A shard's
    rows are ranked within buckets of the key, whose number follows the row count.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    size = F.octet_length(text).cast("long") + F.lit(BYTES_PER_ROW)
    kinds = docs.select(docs[id_col].alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc")).groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("rows"))
    high, low = key_halves(F.col("id"))
    kinds = kinds.withColumns({"high": high, "low": low})
    both = jump_shards(F.col("high"), F.col("low"), [shards, shards + 1])
    kinds = kinds.withColumn("both", both).select("id", "size", "crc", "rows", "high", "low", F.col("both.s0").cast("int").alias("shard"), F.col("both.s1").cast("int").alias("grown"))
    kinds = common.stored(kinds, "shard-kinds")
    bits = max(0, math.ceil(math.log2(max(1, kinds.count()) / shards / GROUP_ROWS)))
    kinds = kinds.withColumn("bucket", F.shiftright("high", 32 - bits))
    before = kinds.groupBy("shard", "bucket").agg(F.sum("rows").alias("rows"))
    earlier = F.expr("sum(rows) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    before = before.select("shard", "bucket", F.coalesce(earlier, F.lit(0)).alias("first"))
    within = F.expr("sum(rows) OVER (PARTITION BY shard, bucket ORDER BY high, low, id, size, crc ROWS UNBOUNDED PRECEDING)")
    ranked = kinds.withColumn("upto", within).join(before, ["shard", "bucket"]).withColumn("from", F.col("first") + F.col("upto") - F.col("rows"))
    blocks = ranked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(UNFOLD).cast("long"))))
    blocks = blocks.repartition("id", "crc", "at")
    slot = F.explode(F.sequence(F.col("from") + F.col("at"), F.col("from") + F.least(F.col("at") + UNFOLD, F.col("rows")) - 1))
    return blocks.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slot.alias("slot"), F.col("grown").alias("grown_shard"))
