"""N-gram Jaccard join by count-vector R-trees (operator 4).

A document's set holds its distinct shingles as 64-bit hashes (a shingle: ``WORDS`` consecutive words, or all
words of a shorter document). Documents of equal sets are one class, found by a 128-bit digest of the set.

*Partitioning.* Two linked sets differ in at most d = (100 - p) (|A| + |B|) / (100 + p) shingles. Shingles are hashed
into K = d + m groups; as a differing shingle spoils one group, at least m groups of a linked pair are equal.
So each class is filed under a digest of every group that isn't empty, and a linked pair meets in at least
m files less its empty groups. K follows the size class of the larger set; a set is filed for every higher class,
too, in which a set can be linked with it (for 67 percent and more that is the next one at most). (Only a set with m or more empty groups is filed under these as well.) A class
that meets others in fewer files than that is linked with none and leaves, and again once others have left;
what remains is tied into coarse components, and every link lies within one of them. Files are combined within
every batch of documents before the shuffle, so a task gets a file at most once from each batch.

*R-tree.* Within a coarse component, shingles are hashed into ``GROUPS`` groups; a set is the point of its group
counts. Points are packed into an R-tree by size and coordinates. The sum of coordinate minima of a point
and a node's upper corner bounds the overlap with every set below; pairs whose own bound suffices are verified
on the sets, highest bound first, and a pair that other links have already joined needs no test. A component
too large for one task is dealt to blocks, and each pair of blocks is one task.

Links join classes to final components, each named by its least id; no list of pairs is ever made.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing; a row
without id links with nothing and has a null component; rows of one id are told apart by their texts, each has
the component of its own text; the order of rows and other columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

#: Words of a shingle, and the least similarity in percent, of near duplicates.
WORDS, PERCENT = 5, 80
#: Coordinates of a point; children of an R-tree node; pairs verified at a time.
GROUPS, FANOUT, AT_ONCE = 64, 32, 32
#: A component of more shingles than UNDIVIDED is dealt to blocks, one for the root of every BLOCK_UNIT of them, so its
#: tasks grow in number as the component does; and at least to so many that a task holds at most TASK_SHINGLES.
UNDIVIDED, BLOCK_UNIT, TASK_SHINGLES = 1_000_000, 60_000, 2_000_000
#: Signatures that one file task holds, and that a batch combines at a time.
TASK_SIGNATURES, BATCH_SIGNATURES = 1_000_000, 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, back to back, and how many each has."""
    raw, begins = common.lined_up(texts)
    data = _LOWER[raw]
    starts, ends = common.spans(~common.WHITE[raw])
    text = np.searchsorted(begins, starts, "right") - 1
    n_words = np.bincount(text, minlength=len(texts))
    word = common.string_hashes(data, starts, ends)
    upto = np.cumsum(n_words)
    whole = np.arange(len(word)) + words <= upto[text]
    first = np.flatnonzero(whole)
    h = np.full(len(first), np.uint64(words))
    for k in range(words):
        h = common.mix64(h * _ODD + word[first + k])
    of = text[first]
    for t in np.flatnonzero((n_words > 0) & (n_words < words)):
        one = np.full(1, np.uint64(n_words[t]))
        for w in word[upto[t] - n_words[t] : upto[t]]:
            one = common.mix64(one * _ODD + w)
        h, of = np.append(h, one), np.append(of, t)
    by = np.argsort(h)
    by = by[np.argsort(of[by].astype(np.int32), kind="stable")]
    h, of = h[by], of[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(texts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Wrapping sums of back-to-back rows."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    end = np.cumsum(counts)
    return upto[end] - upto[end - counts]


def set_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    return tuple(common.mix64(_sums(common.mix64(h ^ np.uint64(salt)), counts) + counts.astype(np.uint64)) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344))


class Scheme:
    """The size classes and, for each, K groups of which r are filed together, with so much slack."""

    def __init__(self, percent: int):
        self.percent, self.lower = percent, [1]
        while len(self.lower) < 60 and self.lower[-1] < 1 << 40:
            self.lower.append(max(self.lower[-1] + 1, self._first(), self.lower[-1] * 3 // 2))
        self.bounds = np.array(self.lower, np.int64)

    def _first(self) -> int:
        """The first class holds all sizes at which no differing pair is linked."""
        return 2 + self.percent // (100 - self.percent) - 1 if len(self.lower) == 1 else 0

    def differ(self, level: int) -> int:
        """Shingles in which linked sets can differ, the larger of which is of this class."""
        top = int(self.bounds[level + 1]) - 1
        return (100 - self.percent) * 2 * top // (100 + self.percent)

    def groups(self, level: int) -> tuple[int, int]:
        """(K, m)."""
        m = 4 + self.differ(level) // 6
        return self.differ(level) + m, m


#: Bits of a node's name that hold the size class it is filed for.
LEVEL_BITS = 6


def signatures(h: np.ndarray, counts: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every file that each set is filed under; the number of the set, the size class it is filed for, and
    the files in which it has to meet another set to be linked with it."""
    sig, who, levels, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    level = np.searchsorted(scheme.bounds, counts, "right") - 1
    end = np.cumsum(counts)
    for c in np.unique(level[counts > 0]).tolist():
        # the classes of all larger sets that it can be linked with
        last = np.searchsorted(scheme.bounds, 100 * int(counts[level == c].max()) // scheme.percent, "right") - 1
        for target in range(c, min(int(last), len(scheme.bounds) - 2) + 1):
            mine = (level == c) & (counts > 0)
            if target > c:
                mine &= 100 * counts >= scheme.percent * scheme.bounds[target]
            sets = np.flatnonzero(mine)
            if not len(sets) or not scheme.differ(target):
                continue
            k, m = scheme.groups(target)
            n = counts[sets]
            row = np.repeat(np.arange(len(sets)), n)
            x = h[np.repeat(end[sets] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            mixed = common.mix64(x + np.uint64(target * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
            at = row * k + (((mixed >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(len(sets) * k, np.uint64)
            np.add.at(total, at, common.mix64(x ^ np.uint64(0xA4093822299F31D0)))
            empty = (np.bincount(at, minlength=len(total)) == 0).reshape(-1, k)
            total = common.mix64(total + common.mix64(np.tile(np.arange(k), len(sets)) + 1000 * target)).reshape(-1, k)
            spare = m - empty.sum(1)
            use = ~empty | (spare <= 0)[:, None]
            need = np.maximum(spare, 1)  # the equal groups of a pair that neither set has empty
            each = use.sum(1)
            sig.append(total[use])
            who.append(np.repeat(sets, each))
            levels.append(np.full(int(each.sum()), target))
            needs.append(np.repeat(need, each))
    return tuple(map(np.concatenate, (sig, who, levels, needs)))


def fewer_needed(file: np.ndarray, owner: np.ndarray, need: np.ndarray) -> np.ndarray:
    """``need`` of each entry, less the names that its owner's entries repeat, and at least 1."""
    mixed = common.mix64(file.view(np.uint64) ^ common.mix64(owner))
    by = np.argsort(mixed, kind="stable")
    again = np.flatnonzero(mixed[by][1:] == mixed[by][:-1]) + 1
    if not len(again):
        return need
    of, repeated = np.unique(owner[by[again]], return_counts=True)
    at = np.minimum(np.searchsorted(of, owner), len(of) - 1)
    return np.maximum(need - np.where(of[at] == owner, repeated[at], 0), 1)


def _met(file: np.ndarray, node: np.ndarray):
    """Entries without repetitions, in the order of their files; which of them share their file with
    another node, and which are the first of their file."""
    by = np.lexsort((node, file))
    file, node = file[by], node[by]
    new = np.ones(len(file), bool)
    new[1:] = (file[1:] != file[:-1]) | (node[1:] != node[:-1])
    file, node = file[new], node[new]
    first = np.ones(len(file), bool)
    first[1:] = file[1:] != file[:-1]
    alone = first & np.append(first[1:], True)[: len(first)]
    return file, node, ~alone, first


class Tree:
    """R-tree over the points of count vectors, packed by size and then by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        n = len(points)
        slab = max(1, int(np.sqrt(n / FANOUT))) * FANOUT
        rank = np.empty(n, np.int64)
        rank[np.argsort(sizes, kind="stable")] = np.arange(n)
        self.order = np.lexsort((points[:, int(np.argmax(points.var(0)))], rank // slab))
        high, least = points[self.order], sizes[self.order]
        most = least
        self.levels = [(high, least, most)]
        while len(high) > FANOUT:
            at = np.arange(0, len(high), FANOUT)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most))

    def near(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sets that may be linked with a set, and their bounds."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            bound = np.minimum(high[at], point).sum(1)
            able = (bound * (100 + percent) >= percent * (size + least[at])) & (100 * most[at] >= percent * size) & (percent * least[at] <= 100 * size)
            at, bound = at[able], bound[able]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at, bound


def spanning_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets that links can join (a spanning forest); with ``side``, from links between
    its two values only."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    end = np.cumsum(sizes)
    begin = end - sizes
    points = np.zeros((n, GROUPS), np.int32)
    flat = np.concatenate(sets)
    np.add.at(points, (np.repeat(np.arange(n), sizes), ((common.mix64(flat) >> np.uint64(32)) * np.uint64(GROUPS) >> np.uint64(32)).astype(np.int64)), 1)
    tree = Tree(points, sizes)
    place = tree.order
    label, members = np.arange(n), [[i] for i in range(n)]
    mark = np.zeros(int(local.max(initial=-1)) + 1, bool)
    links = []
    for here in range(1, n):
        i = int(place[here])
        at, bound = tree.near(points[i], int(sizes[i]), percent)
        before = at < here
        other, bound = place[at[before]], bound[before]
        open_ = label[other] != label[i]
        if side is not None:
            open_ &= side[other] != side[i]
        other = other[open_][np.argsort(-bound[open_], kind="stable")]
        if not len(other):
            continue
        own = local[begin[i] : end[i]]
        mark[own] = True
        while len(other):
            now, other = other[:AT_ONCE], other[AT_ONCE:]
            size = sizes[now]
            cut = np.cumsum(size) - size
            inner = np.arange(size.sum()) - np.repeat(cut, size) + np.repeat(begin[now], size)
            shared = np.add.reduceat(mark[local[inner]], cut, dtype=np.int64)
            for j in now[shared * (100 + percent) >= percent * (size + sizes[i])].tolist():
                if label[j] != label[i]:
                    links.append((i, j))
                    big, small = (label[i], label[j]) if len(members[label[i]]) >= len(members[label[j]]) else (label[j], label[i])
                    label[members[small]] = big
                    members[big] += members[small]
                    members[small] = []
            other = other[label[other] != label[i]]
        mark[own] = False
    return links


def _classed(source: DataFrame, words: int, kind: str) -> DataFrame:
    """One row per document: id, n (size of its set), the digest of the set, key1 and key2, and that of the text."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts, made = common.byte_texts(batch.column(1)), []
                for s, e in common.chunks(texts):
                    h, n = shingles(texts[s:e], words)
                    made.append((n, *(k.view(np.int64) for k in set_keys(h, n))))
                digest = pa.array([hashlib.md5(t or b"").digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*made, strict=True)), digest], ["id", "n", "key1", "key2", "digest"])

    return source.mapInArrow(run, f"id {kind}, n long, key1 long, key2 long, digest binary")


#: In place of a bucket: entries that meet within their batch, and the files that nodes need.
MET, NEEDS = -1, -2


def _filed(source: DataFrame, words: int, scheme: Scheme, buckets: int) -> DataFrame:
    """Entries (files, nodes) back to back: of every file of a batch the first one, by bucket; with whole
    file names those that meet within the batch; and what every node needs. A file's name is its bucket and
    32 bits of its digest. A chance meeting of names of two sets only lets more pairs be tested; groups of one set that
    share a name count once, so the set needs as many files fewer."""

    def named(sig):
        bucket = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return (bucket << np.uint64(32) | sig & np.uint64(0xFFFFFFFF)).view(np.int64)

    def flush(parts):
        file, node, need = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, one = np.unique(node, return_index=True)
        file, node, shared, first = _met(file, node)
        rows = [(NEEDS, need[one].tobytes(), nodes.tobytes()), (MET, file[shared].tobytes(), node[shared].tobytes())]
        file, node = file[first], node[first]
        of = file >> 32
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        low = (file & 0xFFFFFFFF).astype(np.uint32)
        rows += [(int(of[s]), low[s:e].tobytes(), node[s:e].tobytes()) for s, e in zip(cut, np.append(cut, len(of))[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "files", "nodes"])

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = common.byte_texts(batch.column(1).filter(batch.column(0).is_valid()))
            for s, e in common.chunks(texts):
                h, n = shingles(texts[s:e], words)
                sig, who, level, need = signatures(h, n, scheme)
                node = set_keys(h, n)[0].view(np.int64) >> LEVEL_BITS << LEVEL_BITS
                if len(sig):
                    file = named(sig)
                    parts.append((file, node[who] | level, fewer_needed(file, who * len(scheme.bounds) + level, need)))
                if sum(len(p[0]) for p in parts) >= BATCH_SIGNATURES:
                    yield flush(parts)
                    parts.clear()
        if parts:
            yield flush(parts)

    return source.mapInArrow(run, "bucket long, files binary, nodes binary")


def _meetings(batches):
    """The entries (file, node) that share their file, of buckets that come one after the other, and the
    files that nodes need (node, need)."""

    def made(bucket, rows):
        node = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in rows])
        file = np.concatenate([np.frombuffer(r["files"], np.uint32 if bucket >= 0 else np.int64) for r in rows])
        if bucket == NEEDS:
            return pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(file)], ["file", "node", "need"])
        if bucket >= 0:
            file, node, shared, _ = _met(file.astype(np.int64) | bucket << 32, node)
            file, node = file[shared], node[shared]
        return pa.RecordBatch.from_arrays([pa.array(file), pa.array(node), pa.nulls(len(node), pa.int64())], ["file", "node", "need"])

    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["bucket"] != last or last < 0):
                yield made(last, rows)
                rows = []
            last = row["bucket"]
            rows.append(row)
    if rows:
        yield made(last, rows)


#: How often classes that meet in too few files are taken out.
PRUNINGS = 2


def _ties(met: DataFrame) -> DataFrame:
    """Ties (a, b) of the nodes that meet others in as many files as a link needs."""
    met = common.stored(met, "jaccard-met")
    needs = met.where("file is null").groupBy("node").agg(F.max("need").alias("need"))
    met = met.where("file is not null").select("file", "node").distinct()
    for _ in range(PRUNINGS):
        able = met.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(needs, "node").where("n >= need").select("node")
        left = common.stored(met.join(common.stored(able, "jaccard-able"), "node", "left_semi"), "jaccard-left")
        full = left.groupBy("file").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("file", F.shiftright("a", LEVEL_BITS).alias("a"))
        met = left.join(common.stored(full, "jaccard-full"), "file")
        ties = met.select("a", F.shiftright("node", LEVEL_BITS).alias("b"))
        met = met.drop("a")
    return ties.where("a <> b").distinct()


def _linked(percent: int):
    """Links of the R-tree tasks, which come one after the other."""

    def made(rows):
        block = np.array([r["block"] for r in rows])
        side = None if rows[0]["i"] == rows[0]["j"] else block == rows[0]["i"]
        sets = [np.frombuffer(r["members"], np.uint64) for r in rows]
        return [(rows[x]["node"], rows[y]["node"]) for x, y in spanning_links(sets, percent, side)]

    def run(batches):
        last, rows, out, types = None, [], [], None
        for batch in batches:
            types = batch.column("node").type
            for row in batch.to_pylist():
                task = (row["task"], row["i"], row["j"])
                if rows and task != last:
                    out += made(rows)
                    rows = []
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, types) for x in zip(*out, strict=True)], ["a", "b"])
                        out = []
                last = task
                rows.append(row)
        if rows:
            out += made(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, types) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _nodes(classes: DataFrame) -> DataFrame:
    """``classes`` with the node that each is in the graph of links: its least id. Of classes with one least id (rows of
    one id with different texts) the first keeps it, the others are named by 64 bits of their digests (whole numbers)
    or all of them (other ids)."""
    keys = F.struct("key1", "key2")
    shared = classes.groupBy("id").agg(F.min(keys).alias("first"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    shared = common.stored(shared.select("id", "first"), "jaccard-shared")
    whole = isinstance(classes.schema["id"].dataType, T.IntegralType)
    own = F.col("id").cast("long" if whole else "string")
    other = F.xxhash64("key1", "key2") if whole else F.concat(F.lit("~"), F.lpad(F.hex("key1"), 16, "0"), F.lpad(F.hex("key2"), 16, "0"))
    found = classes.join(shared, "id", "left").withColumn("node", F.when(F.col("first") != keys, other).otherwise(own))
    return common.stored(found.drop("first"), "jaccard-classes")


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, n, digest of the text, component (a node; null without id or set) and component_id."""
    source = common.pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    scheme = Scheme(percent)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one shingle for six bytes of text, and (100 - p) / 50 files for a shingle
    buckets = 1 + int(size * (100 - percent) // 300 // (TASK_SIGNATURES // 4))
    plain = common.stored(_classed(source, words, kind), "jaccard-classed")
    classes = common.stored(plain.where("n > 0 and id is not null").groupBy("key1", "key2").agg(F.min("id").alias("id"), F.first("n").alias("n")), "jaccard-classes")
    classes = _nodes(classes)
    node_kind = classes.schema["node"].dataType.simpleString()

    files = _filed(source, words, scheme, buckets)
    tasks = max(2 * source.sparkSession.sparkContext.defaultParallelism, 1 + buckets // 4)
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("nodes"))
    met = files.repartition(tasks, place).sortWithinPartitions("bucket").mapInArrow(_meetings, "file long, node long, need long")
    coarse = graph.components(_ties(met))

    filed = classes.withColumnRenamed("node", "own").withColumn("node", F.shiftright("key1", LEVEL_BITS))
    members = filed.join(coarse, "node").select("id", "own", "key1", "key2", "n", F.col("component").alias("task"))
    members = common.stored(members, "jaccard-members")
    held = F.sum("n")
    parts = F.when(held <= UNDIVIDED, F.lit(1)).otherwise(F.greatest(F.ceil(F.sqrt(held / F.lit(BLOCK_UNIT))), F.ceil(2 * held / F.lit(TASK_SHINGLES))))
    blocks = members.groupBy("task").agg(F.count("*").alias("classes"), parts.cast("long").alias("blocks")).where("classes > 1").select("task", "blocks")
    blocks = common.stored(blocks, "jaccard-blocks")
    members = members.join(blocks, "task").select("id", "own", "key1", "key2", "task", "blocks", F.pmod(F.xxhash64("key2"), "blocks").alias("block"))
    members = common.stored(members, "jaccard-placed")
    texts = source.join(members.hint("merge"), "id")  # the members are a share of all documents: never broadcast

    def reread(batches):
        last = None
        for batch in batches:
            texts_, keys = common.byte_texts(batch.column(1)), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            sets: list[bytes | None] = []
            for s, e in common.chunks(texts_):
                h, n = shingles(texts_[s:e], words)
                key1, key2 = (k.view(np.int64).tolist() for k in set_keys(h, n))
                end = np.cumsum(n)
                for t in range(e - s):
                    same = (key1[t], key2[t]) == keys[s + t] and keys[s + t] != last  # repeated rows of an id come in a row
                    sets.append(h[end[t] - n[t] : end[t]].tobytes() if same else None)
                    last = keys[s + t] if same else last
            full = pa.array(sets, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (4, 5, 6)), full], ["node", "task", "blocks", "block", "members"]).filter(full.is_valid())

    points = texts.select(F.col("own").alias("node"), "text", "key1", "key2", "task", "blocks", "block").mapInArrow(reread, f"node {node_kind}, task long, blocks long, block long, members binary")
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j"))))
    dealt = points.withColumn("pair", pairs).select("node", "task", "pair.i", "pair.j", "block", "members")
    links = dealt.repartition("task", "i", "j").sortWithinPartitions("task", "i", "j").mapInArrow(_linked(percent), f"a {node_kind}, b {node_kind}")
    final = graph.components(links)

    named = classes.join(final, "node", "left").select("key1", "key2", "id", F.coalesce("component", "node").alias("component"))
    named = common.stored(named, "jaccard-named")
    least = common.stored(named.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("classes")).where("classes > 1"), "jaccard-least")
    named = named.join(least.select("component", "component_id"), "component", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    named = common.stored(named.select("key1", "key2", "component", "component_id"), "jaccard-named")
    out = plain.join(named, ["key1", "key2"], "left")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    component_id = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n", "digest", F.when(linked, F.col("component")).alias("component"), component_id.cast(kind).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach)."""
    found = _components(docs, words, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that of least id stays (of several texts with this id
    that of least MD5, of exact copies with this id that of least other columns, null first). Rows without id or without
    words stay. A row goes only if it is in a component with one that stays, whatever rows share its id."""
    rows = common.stored(_components(docs, words, percent, id_col, text_col).where("id is not null"), "jaccard-rows")
    of_first = rows.where("id = component_id and component is not null")
    several = of_first.groupBy("component").agg(F.min("digest").alias("least"), F.max("digest").alias("last")).where("least <> last")
    others = of_first.join(common.stored(several.select("component", "least"), "jaccard-several"), "component").where("digest <> least")
    gone = rows.where("id <> component_id").select("id", "digest").union(others.select("id", "digest")).distinct()
    gone = common.stored(gone.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")), "jaccard-gone")
    # ids of which a text stays are told apart by their texts, the others go by the id alone
    mixed = common.stored(rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_anti").join(
        gone.select("__id").distinct(), F.col("id") == F.col("__id"), "left_semi").select(F.col("id").alias("__mixed")).distinct(), "jaccard-mixed")
    repeated = of_first.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = common.stored(repeated.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")), "jaccard-repeated")

    digest = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))
    same = (docs[id_col] == F.col("__id")) & (digest == F.col("__digest"))
    whole_id = common.stored(gone.join(mixed, F.col("__id") == F.col("__mixed"), "left_anti").select("__id").distinct(), "jaccard-gone-ids")
    left = docs.join(whole_id.hint("merge"), docs[id_col] == F.col("__id"), "left_anti")  # a share of all ids: never broadcast
    if mixed.limit(1).count():
        left = left.join(common.stored(gone.join(mixed, F.col("__id") == F.col("__mixed"), "left_semi"), "jaccard-gone-rows"), same, "left_anti")
    if not repeated.limit(1).count():
        return left
    whole = F.struct(*[docs[c] for c in docs.columns])
    order = F.struct(*[docs[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    one = left.join(repeated, same, "left_semi").groupBy(docs[id_col].alias("__id"), digest.alias("__digest")).agg(F.min_by(whole, order).alias("__row"))
    return left.join(repeated, same, "left_anti").union(one.select("__row.*"))
