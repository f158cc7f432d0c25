"""Chat formatting with collapse of cumulative snapshots (operator 3).

A logger that stores a conversation after every reply leaves conversations that are prefixes of longer ones.
Every turn gets a rolling hash of the turns up to it: the running XOR of hashes of (position, role, text),
128 bits. A conversation is dropped if its last hash, at its length, is the hash of a proper prefix of another
(an anti-join on distinct hashes), and of equal conversations the one of least id stays. The rest is rendered.

Positions and rolling hashes are made in two levels, within ranges of ``RANGE`` turn numbers and over the
ranges, so a conversation with very many turns is spread over its ranges. Only digests are shuffled until the
maximal conversations are known; hashes are made distinct, and conversations combined, before their shuffles.

Defined results: rows without conversation id belong to none and are left out; the turns of a conversation are
ordered by turn number (null first), role and digest; exactly repeated rows are one turn; a null role or text
differs from an empty one and is rendered as empty; an empty table gives an empty one; other columns are not
read. A rendered conversation is cut into segments of ``SEGMENT`` turns, of one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RANGE, SEGMENT = 64, 256
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|", "|>\n", "<|end|>\n"


def _digest():
    parts = [F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(c, F.lit(""))) for c in ("role", "text")]
    return F.md5(F.concat(parts[0], F.lit("\x1f"), parts[1]).cast("binary"))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    turns = common.pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    return turns.withColumns({"turn": F.col("turn").cast("long"), "digest": _digest()})


def rolled(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, pos, a, b): each turn's position from 1 on and the hash of the turns up to it."""
    narrow = turns.select("conv", "turn", "role", "digest").distinct().withColumn("span", F.floor(F.col("turn") / F.lit(RANGE)))
    narrow = common.stored(narrow, "chat-turns")
    by_span = "PARTITION BY conv ORDER BY span NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    inner = "PARTITION BY conv, span ORDER BY turn NULLS FIRST, role NULLS FIRST, digest"
    counts = narrow.groupBy("conv", "span").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("conv").alias("c"), F.col("span").alias("s"), F.expr(f"coalesce(sum(n) OVER ({by_span}), 0)").alias("before"))
    placed = narrow.withColumn("rn", F.expr(f"row_number() OVER ({inner})")).join(before, (F.col("conv") == F.col("c")) & F.col("span").eqNullSafe(F.col("s")))
    placed = placed.withColumn("pos", F.col("before") + F.col("rn"))
    placed = placed.withColumns({"ha": F.xxhash64("pos", "digest"), "hb": F.xxhash64("digest", "pos", F.lit(1))})
    placed = common.stored(placed.select("conv", "span", "turn", "role", "digest", "pos", "ha", "hb"), "chat-placed")
    sums = placed.groupBy("conv", "span").agg(F.expr("bit_xor(ha)").alias("a"), F.expr("bit_xor(hb)").alias("b"))
    earlier = sums.select(F.col("conv").alias("c"), F.col("span").alias("s"), *[F.expr(f"coalesce(bit_xor({x}) OVER ({by_span}), 0)").alias(f"{x}0") for x in "ab"])
    run = {x: F.expr(f"bit_xor(h{x}) OVER (PARTITION BY conv, span ORDER BY pos ROWS UNBOUNDED PRECEDING)") for x in "ab"}
    inside = placed.withColumns(run).join(earlier, (F.col("conv") == F.col("c")) & F.col("span").eqNullSafe(F.col("s")))
    return inside.select("conv", "turn", "role", "digest", "pos", F.expr("a ^ a0").alias("a"), F.expr("b ^ b0").alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n): the conversations that no other one extends, of equal ones that of least id, and their lengths."""
    lengths = turns.groupBy(F.col("conv").alias("whole")).agg(F.max("pos").alias("n"))
    ends = turns.join(lengths, F.col("conv") == F.col("whole"))
    full = ends.where("pos = n").groupBy("n", "a", "b").agg(F.min("conv").alias("conv"))
    prefixes = ends.where("pos < n").select(F.col("pos").alias("n"), "a", "b").distinct()
    return full.join(prefixes, ["n", "a", "b"], "left_anti").select("conv", "n")


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per segment of every maximal conversation: id, segment from 0 on, n_turns of the conversation, chat."""
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    places = common.stored(rolled(turns), "chat-rolled")
    kept = common.stored(maximal(places), "chat-maximal")
    chosen = places.join(kept, "conv").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), "pos", "n")
    same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("digest") == F.col("d"))
    texts = turns.join(common.stored(chosen, "chat-chosen"), same).dropDuplicates(["conv", "pos"])
    shown = F.concat(F.lit(ROLE_OPEN), F.coalesce("role", F.lit("")), F.lit(ROLE_CLOSE), F.coalesce("text", F.lit("")), F.lit("\n" + TURN_CLOSE))
    shown = texts.select("conv", "pos", "n", F.floor((F.col("pos") - 1) / F.lit(SEGMENT)).cast("int").alias("segment"), shown.alias("turn"))
    listed = shown.groupBy("conv", "segment", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("turns"))
    chat = F.array_join(F.transform("turns", lambda x: x["turn"]), "")
    return listed.select(F.col("conv").alias(conv_col), "segment", F.col("n").alias("n_turns"), chat.alias("chat"))
