"""Prefix trie of conversations in double arrays (operator 11).

A node is a distinct sequence of first turns (role, text); it knows its members (conversations that begin with it),
children, leaves and what sharing saves in its subtree, and the digest of the conversations that end there.

1. Turns get positions and 128-bit rolling hashes of the turns up to them. Order and hashes are made in ranges (of
   the sorted turns, then of positions), so one conversation with very many turns is spread over tasks.
2. Equal conversations become one class with a count, so copies are one path.
3. A node is *upper* if over ``SHARD_TURNS`` turns of classes lie at or below it. Upper nodes are closed towards the
   root. Below each upper node hang whole subtrees of at most that many turns: the prefix shards.
4. A task reads its shards in order and packs one double array at a time (some whole shards, about ``PACKED_TURNS``
   turns): turn digests become dense ids, BASE and CHECK are filled level by level with first-fit placement, and the
   paths are traversed through the arrays for the nodes and, bottom up, their subtree sums.
5. Upper nodes are shared by shards: their members are grouped sums over all shards, their subtree sums take in the
   shards' top nodes and are merged along the upper tree by ancestor doubling (a logarithmic number of joins).

The digest of the members that end at a node is fed block by block of ``BLOCK`` ids in order, with bounded memory.

Defined results: rows without conversation id are left out; turns are ordered by turn number (null first), then by
the MD5 of (role, text); a null role or text is empty; exactly repeated rows are equal turns, each a position;
ids are cast to long and the group of a negative one is that of SQL's remainder; an empty table has no node (no member, so no root);
conversations without turns are members of the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns below a node that one shard may hold, turns that one double array is meant to hold (of whole shards);
#: positions of one window group, ids of one block of a digest, copies unfolded at a time.
SHARD_TURNS, PACKED_TURNS = 2_048, 32_768
RANGE, BLOCK, UNFOLD = 4_096, 4_096, 4_096
#: Conversations c take their first crc32(c) % HEADS turns from conversation c - c % GROUP.
GROUP, HEADS = 20, 4
KEY = ["depth", "a", "b"]


@dataclass(frozen=True)
class Conversations:
    """``sizes``: (conv, size) of every conversation, ``turns``: (conv, pos from 1 on, digest, words), both stored."""

    sizes: DataFrame
    turns: DataFrame


def plain(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Conversations:
    """The conversations as they are."""
    turns = common.pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = turns.select(F.col("conv").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))
    kinds = turns.where("conv is not null").groupBy("conv", "turn", "digest").agg(F.min("words").alias("words"), F.count(F.lit(1)).alias("n"))
    blocks = kinds.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {UNFOLD}L)")))
    rows = blocks.select("conv", "turn", "digest", "words", F.explode(F.expr(f"sequence(at, least(at + {UNFOLD - 1}, n - 1))")).alias("copy"))
    ranged = rows.repartitionByRange("conv", "turn", "digest", "copy").withColumn("part", F.spark_partition_id())
    ranged = common.stored(ranged, "trie-ranged")
    before = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    before = common.stored(before.where("before > 0"), "trie-before")
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "digest", "copy"))
    placed = ranged.withColumn("rank", inside).join(before, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    placed = common.stored(placed.select("conv", (F.col("rank") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "words"), "trie-placed")
    return Conversations(common.stored(placed.groupBy("conv").agg(F.max("pos").alias("size")), "trie-sizes"), placed)


def rebuilt(conversations: DataFrame, **columns: str) -> Conversations:
    """Every conversation c with its first h = crc32(c) % ``HEADS`` turns exchanged for those of c - c % ``GROUP``."""
    whole = plain(conversations, **columns)
    base, h = F.col("conv") - F.col("conv") % GROUP, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = whole.sizes.select("conv", "size", base.alias("base"), h.alias("h"))
    of_base = whole.sizes.select(F.col("conv").alias("base"), F.col("size").alias("there"))
    convs = convs.join(of_base, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = common.stored(convs.withColumn("rest", F.greatest(F.col("size") - F.col("h"), F.lit(0))), "trie-convs")
    heads = whole.turns.where((F.col("pos") < HEADS) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "base")
    heads = convs.where("k > 0").select("conv", "base", "k").join(heads, "base").where("pos <= k").select("conv", "pos", "digest", "words")
    own = whole.turns.join(convs.select("conv", "h", "k"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words")
    return Conversations(convs.select("conv", (F.col("k") + F.col("rest")).alias("size")), common.stored(heads.union(own), "trie-rebuilt"))


def rolled(turns: DataFrame) -> DataFrame:
    """``turns`` with the hash (a, b) of the turns up to each one and (pa, pb) of those before it, stored."""
    span = F.floor((F.col("pos") - 1) / F.lit(RANGE)).cast("long")
    hashed = turns.withColumns({"span": span, "ha": F.xxhash64("pos", "digest"), "hb": F.xxhash64("digest", "pos", F.lit(1))})
    run = Window.partitionBy("conv", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv", "span").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"))
    over = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col("conv").alias("c"), F.col("span").alias("s"), F.bit_xor("sa").over(over).alias("a0"), F.bit_xor("sb").over(over).alias("b0"))
    earlier = common.stored(earlier.where("s > 0"), "trie-earlier")
    inside = hashed.withColumns({"ra": F.bit_xor("ha").over(run), "rb": F.bit_xor("hb").over(run)})
    inside = inside.join(earlier, (F.col("conv") == F.col("c")) & (F.col("span") == F.col("s")), "left")
    both = inside.withColumns({x: F.col(f"r{x}").bitwiseXOR(F.coalesce(f"{x}0", F.lit(0).cast("long"))) for x in "ab"})
    before = [F.col(x).bitwiseXOR(F.col(f"h{x}")).alias(f"p{x}") for x in "ab"]
    return common.stored(both.select("conv", "pos", "digest", "words", "a", "b", *before), "trie-rolled")


class DoubleArray:
    """A trie over dense symbols: a child of state s by symbol c is the cell BASE[s] + c, if CHECK there is s."""

    def __init__(self):
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0  # the root
        self.end, self.holes = 1, np.zeros(0, np.int64)

    def _cells(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _first_fit(self, gaps: np.ndarray) -> int:
        """The first cell for a state's first child, so that the others fit at the distances ``gaps``."""
        at = self.holes
        for gap in gaps[1:].tolist():
            if not len(at):
                break
            to = at + gap
            at = at[(to >= self.end) | (self.check[np.minimum(to, len(self.check) - 1)] == -1)]
        return int(at[0]) if len(at) else self.end

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Give each parent its children, which are all of them: pairs sorted by parent and symbol."""
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        size = np.diff(np.append(first, len(parents)))
        for i in np.flatnonzero(size > 1).tolist():
            own = symbols[first[i] : first[i] + size[i]]
            at = self._first_fit(own - own[0])
            self._cells(int(at + own[-1] - own[0]) + 1)
            cells = at + own - own[0]
            self.base[parents[first[i]]], self.check[cells] = at - own[0], parents[first[i]]
            fresh = np.arange(self.end, max(self.end, int(cells[-1]) + 1))
            self.end = max(self.end, int(cells[-1]) + 1)
            self.holes = np.concatenate((self.holes, fresh))
            self.holes = self.holes[self.check[self.holes] == -1]
        only = first[size == 1]
        short = max(0, len(only) - len(self.holes))
        cells = np.concatenate((self.holes[: len(only)], np.arange(self.end, self.end + short)))
        self.holes, self.end = self.holes[len(only) :], self.end + short
        self._cells(self.end)
        self.base[parents[only]], self.check[cells] = cells - symbols[only], parents[only]

    def walk(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states that follow, or -1 where there is none."""
        to = self.base[states] + symbols
        inside = (to > 0) & (to < self.end)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def packed(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of the paths symbols[begin : begin + length], and the state that each symbol leads to."""
    trie, states = DoubleArray(), np.zeros(len(symbols), np.int64)
    kinds = int(symbols.max(initial=0)) + 1
    live, at = np.arange(len(begin)), np.zeros(len(begin), np.int64)
    for level in range(int(length.max(initial=0))):
        live = live[length[live] > level]
        here = begin[live] + level
        pairs = np.unique(at[live] * kinds + symbols[here])
        trie.add(pairs // kinds, pairs % kinds)
        at[live] = states[here] = trie.walk(at[live], symbols[here])
    return trie, states


def dense(values: np.ndarray) -> np.ndarray:
    """Numbers of the values in the order in which they first come."""
    _, first, of = np.unique(values, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return number[of]


_NODE = "depth long, a long, b long, conv long, parent_conv long, pa long, pb long, top boolean, n_convs long, n_children long, n_leaves long, saved long"
_ROW = ["sa", "sb", "conv", "depth", "digest", "words", "a", "b", "pa", "pb", "members"]


def _shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes of some whole shards: rows of classes, sorted by shard, class and depth."""
    col = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    sa, sb, conv, depth, words, a, b, pa_, pb, members = (col[c].to_numpy() for c in _ROW if c != "digest")
    begin = np.flatnonzero((np.diff(conv, prepend=conv[0] - 1) != 0) | (np.diff(sa, prepend=0) != 0) | (np.diff(sb, prepend=0) != 0))
    length = np.diff(np.append(begin, len(conv)))
    shard = np.cumsum((np.diff(sa, prepend=sa[0] - 1) != 0) | (np.diff(sb, prepend=sb[0]) != 0))
    symbol = col["digest"].dictionary_encode().indices.to_numpy().astype(np.int64) + shard[-1] + 1
    symbol[begin] = shard[begin]  # a path begins with its shard's top node
    _, state = packed(dense(symbol), begin, length)
    node, at, of = np.unique(state, return_index=True, return_inverse=True)
    n, least = np.zeros(len(node), np.int64), np.full(len(node), np.iinfo(np.int64).max)
    np.add.at(n, of, members)
    np.minimum.at(least, of, conv)
    top = np.zeros(len(conv), bool)
    top[begin] = True
    top = top[at]
    parent = np.where(top, -1, of[np.maximum(at - 1, 0)])  # the row before it is of the same path
    children = np.bincount(parent[~top], minlength=len(node))
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * words[at]
    deep = np.argsort(-depth[at], kind="stable")
    for some in np.split(deep, np.flatnonzero(np.diff(depth[at][deep])) + 1):
        some = some[~top[some]]
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    above = pa.array(least[parent], mask=top)
    columns = [depth[at], a[at], b[at], least, above, pa_[at], pb[at], top, n, children, leaves, saved]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in _NODE.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted rows, some whole shards of about ``PACKED_TURNS`` rows at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows >= PACKED_TURNS:
            sa, sb = (held.column(c).to_numpy() for c in ("sa", "sb"))
            cut = np.flatnonzero((sa != sa[-1]) | (sb != sb[-1]))  # the last shard may go on
            if len(cut):
                yield _shard_nodes(held.slice(0, int(cut[-1]) + 1))
                held = held.slice(int(cut[-1]) + 1)
    if held is not None and held.num_rows:
        yield _shard_nodes(held)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end."""
    blocks = ends.groupBy(*KEY, F.floor(F.col("conv") / F.lit(BLOCK)).alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    blocks = blocks.select(*KEY, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for *of, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if of != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = of, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digest_batch(done)
        if key is not None:
            yield _digest_batch([(*key, digest.hexdigest())])

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEY, "ends_sha256"])


def _upper(heavy: DataFrame, ends: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes above the shards, root included, with sums over all that lies below: columns as of the shards' nodes."""
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in KEY], F.lit(None).cast("long").alias("up"), zero.alias("pa"), zero.alias("pb"), "conv", "n_convs", zero.alias("words"))
    nodes = common.stored(heavy.select(*KEY, (F.col("depth") - 1).alias("up"), "pa", "pb", "conv", "n_convs", "words").union(root), "trie-upper")
    above = [F.col("up").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    hung = tops.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "n_leaves", "saved")
    hung = hung.union(nodes.where("up is not null").select(*above, zero, zero))
    hung = hung.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    nodes = nodes.join(hung, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = (F.col("n_convs") - 1) * F.col("words")
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.coalesce("n_leaves", zero))
    nodes = common.stored(nodes.withColumns({"n_leaves": leaves.cast("long"), "saved": own + F.coalesce("saved", zero)}), "trie-upper")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select(*KEY, F.col("up").alias("ud"), F.col("pa").alias("ua"), F.col("pb").alias("ub"), "n_leaves", "saved")
    for _ in range(int(deepest).bit_length()):  # sums reach twice as far down with each round
        given = sums.where("ud is not null").groupBy("ud", "ua", "ub").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        given = given.select(F.col("ud").alias("depth"), F.col("ua").alias("a"), F.col("ub").alias("b"), "l", "s")
        far = sums.select(F.col("depth").alias("ud"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("ud").alias("fd"), F.col("ua").alias("fa"), F.col("ub").alias("fb"))
        both = sums.join(given, KEY, "left").join(far, ["ud", "ua", "ub"], "left")
        both = both.select(*KEY, F.col("fd").alias("ud"), F.col("fa").alias("ua"), F.col("fb").alias("ub"), *[(F.col(c) + F.coalesce(x, zero)).alias(c) for c, x in (("n_leaves", "l"), ("saved", "s"))])
        sums = common.stored(both, "trie-sums")
    nodes = nodes.drop("n_leaves", "saved").join(sums.select(*KEY, "n_leaves", "saved"), KEY)
    return nodes.select(*KEY, "conv", F.lit(None).cast("long").alias("parent_conv"), "pa", "pb", (F.col("depth") > 0).alias("top"), "n_convs", "n_children", "n_leaves", "saved")


def nodes(conversations: Conversations, conv_col: str = "conv_id", shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie."""
    zero = F.lit(0).cast("long")
    turns = rolled(conversations.turns)
    last = conversations.sizes.select("conv", F.col("size").alias("depth"))
    ends = last.join(turns.select("conv", F.col("pos").alias("depth"), "a", "b"), ["conv", "depth"], "left")
    ends = common.stored(ends.select("conv", "depth", *[F.coalesce(x, zero).alias(x) for x in "ab"]), "trie-ends")
    classes = ends.where("depth > 0").groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("members"))
    classes = common.stored(classes.select("conv", F.col("depth").alias("size"), "members"), "trie-classes")
    rows = common.stored(turns.withColumnRenamed("pos", "depth").join(classes, "conv"), "trie-rows")
    weight = F.sum(F.col("size") - F.col("depth") + 1)
    least = [F.min(c).alias(c) for c in ("pa", "pb", "conv", "words")]
    heavy = rows.groupBy(*KEY).agg(weight.alias("weight"), F.sum("members").alias("n_convs"), *least).where(F.col("weight") > shard_turns)
    heavy = common.stored(heavy, "trie-heavy")
    light = common.stored(rows.join(heavy.select(*KEY), KEY, "left_anti"), "trie-light")
    tops = light.groupBy("conv").agg(F.min(F.struct(*KEY)).alias("top")).select("conv", F.col("top.a").alias("sa"), F.col("top.b").alias("sb"))
    sharded = light.join(tops, "conv").select(*_ROW).repartition("sa", "sb").sortWithinPartitions("sa", "sb", "conv", "depth")
    below = common.stored(sharded.mapInArrow(_shards, _NODE), "trie-nodes")
    upper = common.stored(_upper(heavy, ends, below.where("top")), "trie-merged")
    found = below.union(upper)
    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("above"), F.lit(True).alias("top"))
    found = found.join(parents, ["depth", "pa", "pb", "top"], "left").join(_digests(ends), KEY, "left")
    return found.select(
        F.col("conv").alias(conv_col),
        "depth",
        F.coalesce("parent_conv", "above").alias(f"parent_{conv_col}"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
