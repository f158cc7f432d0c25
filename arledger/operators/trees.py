"""C4: the boosted trees of MLlib's ``GBTClassifier`` (logistic loss) on binned rows.

MLlib runs two stages for each level of each tree, on JVM objects. Here rows are a byte a feature and are counted by node,
feature and bin in numpy. Few rows are fitted in one task, all rounds in one go. More rows are dealt to tasks: each level is
one job of one stage, whose tasks send their counts to the driver, which finds the splits. What a round makes of the rows
(score, sample, targets, nodes) waits for the next job in files of the executor's temp folder, and is made again from the rows
and trees if it isn't there; of two children only the one with fewer rows is counted.

The trees are those that MLlib grows: its candidate splits (``findSplits``), its sample of the rows of every partition and of
the features of every node, its gains, least rows and order of ties. Rows of one partition are summed in MLlib's order.
Those of several are summed in whole multiples of a power of two (below 1e-7 of a row's weight at 30 million rows), so
sums don't depend on the number of tasks or on the order in which they end, as MLlib's do in their last bits; a split that
gains nothing beyond such bits isn't made.
"""

from __future__ import annotations

import functools
import math
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, tables_dir

#: Rows that one task fits alone, and rows that are counted at a time.
TASK_ROWS, CHUNK_ROWS = 1_000_000, 131_072
#: Numbers drawn side by side.
LANES = 4096
#: A child of less impurity is a leaf; gains up to this share of the mean square are rounding (rows of several partitions).
PURE, ROUNDING = 2.0**-52, 1e-12
#: Makes 13 bits of a target: a node of targets that are all the same has marks that are.
MARK = np.uint64(0x9E3779B97F4A7C15)

_U = np.uint64
_M32, _M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


# ---- the random numbers of Spark and Java -------------------------------------------------------------------------------
def _bytes_hash(data: bytes, seed: int) -> int:
    """Scala's MurmurHash3 of bytes (a multiple of four)."""
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _M32
        k = (k << 15 | k >> 17) & _M32
        h ^= k * 0x1B873593 & _M32
        h = ((h << 13 | h >> 19) & _M32) * 5 + 0xE6546B64 & _M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


def hash_seed(seed: int) -> int:
    """The first state of Spark's XORShiftRandom."""
    data = (seed & _M64).to_bytes(8, "big")
    low = _bytes_hash(data, 0x3C074A61)
    return _bytes_hash(data, low) << 32 | low


def _step(x: np.ndarray) -> None:
    x ^= x << _U(21)
    x ^= x >> _U(35)
    x ^= x << _U(4)


def _apply(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States after the steps of a 64 x 64 bit matrix."""
    out = np.zeros_like(states)
    for b in range(64):
        out ^= columns[b] * (states >> _U(b) & _U(1))
    return out


class Draws:
    """The first ``n`` of XORShiftRandom's ``nextDouble``, in lanes that start where the one before ends."""

    def __init__(self, n: int):
        self.n, self.lanes = n, max(1, min(LANES, n // 16))
        self.each = -(-n // self.lanes)
        power = _U(1) << np.arange(64, dtype=np.uint64)
        _step(power)
        jump, left = _U(1) << np.arange(64, dtype=np.uint64), 2 * self.each
        while left:
            jump = _apply(power, jump) if left & 1 else jump
            power, left = _apply(power, power), left >> 1
        # the lanes' first states are sums (XOR) of those that every bit of the seed gives
        self.starts = (_U(1) << np.arange(64, dtype=np.uint64))[:, None]
        while self.starts.shape[1] < self.lanes:
            self.starts = np.concatenate((self.starts, _apply(jump, self.starts)), axis=1)
            jump = _apply(jump, jump)
        self.starts = np.ascontiguousarray(self.starts[:, : self.lanes])

    def below(self, seed: int, rate: float) -> np.ndarray:
        """Which of the numbers are less than ``rate``."""
        first = hash_seed(seed)
        states = np.bitwise_xor.reduce(self.starts[[b for b in range(64) if first >> b & 1]], axis=0)
        limit, out = _U(math.ceil(rate * 2.0**53)), np.empty((self.each, self.lanes), bool)
        for i in range(self.each):
            _step(states)
            high = (states & _U((1 << 26) - 1)) << _U(27)
            _step(states)
            out[i] = high + (states & _U((1 << 27) - 1)) < limit
        return out.T.ravel()[: self.n]


def _nextdouble(state: int) -> tuple[float, int]:
    bits = []
    for n in (26, 27):
        state ^= state << 21 & _M64
        state ^= state >> 35
        state ^= state << 4 & _M64
        bits.append(state & (1 << n) - 1)
    return ((bits[0] << 27) + bits[1]) * 2.0**-53, state


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """``SamplingUtils.reservoirSampleAndCount`` of the numbers up to ``n``."""
    kept, state = list(range(min(k, n))), hash_seed(seed)
    for item in range(k, n):
        u, state = _nextdouble(state)
        at = int(u * (item + 1))
        if at < k:
            kept[at] = item
    return kept


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        v = self.state >> 16
        return v - (1 << 32) if v >> 31 else v

    def next_long(self) -> int:
        return ((self._next() << 32) + self._next()) & _M64


# ---- one tree -----------------------------------------------------------------------------------------------------------
@dataclass
class Plan:
    """What all tasks know of a fit."""

    splits: list[list[float]]  # candidate thresholds of every feature
    per_node: int  # features that a node may split on
    rounds: int
    depth: int
    step: float
    rate: float
    least: int  # rows of a child
    seed: int
    weights: tuple[float, float]  # of labels 0 and 1
    bits: int | None  # sums are in multiples of 2 ** -bits (None: in the rows' order)

    @property
    def bins(self) -> int:
        return max(map(len, self.splits), default=0) + 1


@dataclass
class Tree:
    """Nodes by number; ``left`` of a leaf is the leaf. ``stats``: rows, weight, sum and (rows of one partition) sum of squares."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    stats: list[np.ndarray] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, stats: np.ndarray, impurity: float) -> int:
        here = len(self.left)
        for to, v in ((self.feature, 0), (self.cut, 255), (self.left, here), (self.stats, stats), (self.impurity, impurity), (self.gain, 0.0)):
            to.append(v)
        return here

    def values(self) -> np.ndarray:
        return np.array([s[2] / s[1] if s[1] else 0.0 for s in self.stats])


class Routes:
    """A tree for moving rows (codes: a row a feature) from node to node."""

    def __init__(self, tree: Tree):
        self.values = tree.values()
        self.kind = np.uint8 if len(tree.left) < 256 else np.uint16
        self.levels, level = [], [0] if tree.left else []
        while level := [v for v in level if tree.left[v] != v]:
            self.levels.append([(v, tree.feature[v], 2 * tree.cut[v] + 1, tree.left[v] - v) for v in level])
            level = [k for v in level for k in (tree.left[v], tree.left[v] + 1)]

    def move(self, codes: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
        """The nodes after a level of the tree; nodes are compared one by one, in bytes, which is faster than to look up each row's."""
        node = node.astype(self.kind)
        for v, f, code, to in self.levels[depth] if depth < len(self.levels) else ():
            hit = node == v
            node += hit.view(np.uint8) * self.kind(to)
            hit &= codes[f] > code
            node += hit.view(np.uint8)
        return node

    def moved(self, codes: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
        return np.concatenate([self.move(codes[:, s : s + CHUNK_ROWS], node[s : s + CHUNK_ROWS], depth) for s in range(0, len(node), CHUNK_ROWS)] or [node])

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(codes.shape[1], self.kind)
        for s in range(0, len(node), CHUNK_ROWS):
            for depth in range(len(self.levels)):
                node[s : s + CHUNK_ROWS] = self.move(codes[:, s : s + CHUNK_ROWS], node[s : s + CHUNK_ROWS], depth)
        return node


def targets(codes: np.ndarray, score: np.ndarray, first: bool, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The targets of some rows (labels at first, then minus the gradients of the loss) and their weights."""
    late = (codes[0] & 1).astype(bool)
    sign = np.where(late, 1.0, -1.0)
    weight = np.where(late, plan.weights[1], plan.weights[0])
    if first:
        return sign, weight
    power = 2.0 * sign * score
    if plan.bits is None:  # the last bit of the JVM's, which can decide between splits into the same rows; numpy's own is less exact
        some, of = np.unique(power, return_inverse=True)
        return 4.0 * sign / (1.0 + np.array([math.exp(v) for v in some.tolist()]).take(of)), weight
    return 4.0 * sign / (1.0 + np.exp(power)), weight


def sums_of(y: np.ndarray, w: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """What is summed of sampled rows: weights, weighted targets and squares; or whole multiples of the weighted targets, and marks."""
    if plan.bits is None:
        return [w, w * y, w * y * y]
    return [np.rint(np.ldexp(w * y, plan.bits)), ((y.view(np.uint64) * MARK) >> _U(51)).astype(float)]


def counted(codes: np.ndarray, sums: list[np.ndarray], node: np.ndarray, slots: np.ndarray, n: int, plan: Plan) -> list[np.ndarray]:
    """Rows and sums of sampled rows by feature, slot of the node (of ``n``; -1: none) and bin (or 2 * bin + label); of marks by slot."""
    exact = plan.bits is None
    width = plan.bins * (1 if exact else 2)
    out = [np.zeros((len(codes), n * width), np.int64), *(np.zeros((len(codes), n * width)) for _ in (sums if exact else sums[:1]))]
    marks = np.zeros((2, n))
    for s in range(0, len(node), CHUNK_ROWS):
        of = slots.take(node[s : s + CHUNK_ROWS].astype(np.intp))
        some = np.flatnonzero(of >= 0)
        pick = (lambda v, s=s: v[s : s + CHUNK_ROWS]) if len(some) == len(of) else (lambda v, s=s, some=some: v[s : s + CHUNK_ROWS].take(some))
        of = of if len(some) == len(of) else of.take(some)
        base, now = of * width, [pick(v) for v in sums]
        for f, row in enumerate(codes):
            key = pick(row) >> 1 if exact else pick(row)
            key = base + key
            out[0][f] += np.bincount(key, minlength=n * width)
            for to, v in zip(out[1:], now if exact else now[:1], strict=True):
                to[f] += np.bincount(key, weights=v, minlength=n * width)
        if not exact:
            marks += np.stack([np.bincount(of, weights=now[1], minlength=n), np.bincount(of, weights=now[1] * now[1], minlength=n)])
    return out if exact else [*out, marks]


def squares_of(leaf: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, plan: Plan) -> np.ndarray:
    """Sums of the squares of sampled rows by leaf, in whole multiples."""
    return np.bincount(leaf, weights=np.rint(np.ldexp(w * y * y, plan.bits - 2)), minlength=n)


def _table(parts: list[np.ndarray], n: int, plan: Plan) -> np.ndarray:
    """(slot, feature, bin, rows / weight / sum / ...) of merged counts."""
    shape = (len(plan.splits), n, plan.bins)
    if plan.bits is None:
        return np.stack([p.reshape(shape).astype(float) for p in parts], axis=-1).swapaxes(0, 1)
    rows, wy = parts[0].reshape(*shape, 2), parts[1].reshape(*shape, 2).sum(-1)
    return np.stack([rows.sum(-1).astype(float), rows @ np.array(plan.weights), np.ldexp(wy, -plan.bits)], axis=-1).swapaxes(0, 1)


def _variance(s: np.ndarray) -> np.ndarray:
    count = np.where(s[..., 1] == 0, 1.0, s[..., 1])
    return np.where(s[..., 1] == 0, 0.0, (s[..., 3] - s[..., 2] * s[..., 2] / count) / count)


def _best(table: np.ndarray, subset: list[int], stats: np.ndarray | None, impurity: float, plan: Plan):
    """(feature, bin, gain, left stats, right stats, stats, impurity) of a node's best split; the feature is None without one."""
    table = table[subset]
    upto = np.cumsum(table, axis=1)
    left = upto[:, :-1]
    right = upto[:, -1:] - left
    exact = plan.bits is None
    if stats is None:
        stats = left[0, 0] + right[0, 0] if left.shape[1] else upto[0, -1]
        impurity = float(_variance(stats)) if exact else 0.0
    if not left.shape[1]:
        return None, 0, 0.0, None, None, stats, impurity
    lw, rw = left[..., 1], right[..., 1]
    total = lw + rw
    with np.errstate(divide="ignore", invalid="ignore"):
        if exact:
            gain = impurity - lw / total * _variance(left) - rw / total * _variance(right)
        else:
            gain = (left[..., 2] ** 2 / lw + right[..., 2] ** 2 / rw - stats[2] ** 2 / stats[1]) / stats[1]
    allowed = (left[..., 0] >= plan.least) & (right[..., 0] >= plan.least) & (gain >= 0)
    allowed &= np.arange(left.shape[1]) < np.array([len(plan.splits[f]) for f in subset])[:, None]
    gain = np.where(allowed, gain, -np.inf)
    k, cut = divmod(int(np.argmax(gain)), left.shape[1])
    best = float(gain[k, cut])
    if best <= (0 if exact else ROUNDING * (stats[2] / stats[1]) ** 2):
        return None, 0, 0.0, None, None, stats, impurity if best >= 0 else -1.0  # MLlib's mark of a leaf without a valid split
    return subset[k], cut, best, left[k, cut], right[k, cut], stats, impurity


def _same_targets(table: np.ndarray, marks: np.ndarray, stats: np.ndarray, plan: Plan) -> bool:
    """Whether all targets of a node are the same, so that it has no impurity: their marks are (then the rows times the marks'
    squares are the square of the sum), and no feature tells them apart."""
    if int(stats[0]) * int(marks[1]) != int(marks[0]) ** 2:
        return False
    return _best(table, list(range(len(plan.splits))), stats, 0.0, replace(plan, least=1))[0] is None


#: For the tree so far, its level, the slots of its nodes and their number: what ``counted`` gives of all rows.
Count = Callable[["Tree", int, np.ndarray, int], list[np.ndarray]]


def grow(m: int, plan: Plan, count: Count) -> Tree:
    """The tree of round ``m``."""
    tree, rng, features = Tree(), JavaRandom(plan.seed + m), len(plan.splits)
    tree.add(np.zeros(4), 0.0)
    level, tables, pairs = [0], {}, {}
    for depth in range(plan.depth):
        if not level:
            break
        # of two children the one with fewer rows is counted, the other is the parent less it (sums are exact)
        lighter = lambda a, b: a if tree.stats[a][0] <= tree.stats[b][0] else b
        nodes = level if plan.bits is None or not depth else sorted({lighter(a, b) for a, b in pairs.values()})
        slots = np.full(len(tree.left), -1, np.intp)
        slots[nodes] = np.arange(len(nodes))
        parts = count(tree, depth, slots, len(nodes))
        sums = None if plan.bits is None else parts.pop()
        table = _table(parts, len(nodes), plan)
        now = {node: (table[k], None if sums is None else sums[:, k]) for k, node in enumerate(nodes)}
        if len(now) < len(level):
            for parent, (a, b) in pairs.items():
                one = lighter(a, b)
                now[b if one == a else a] = tuple(x - y for x, y in zip(tables[parent], now[one], strict=True))
        if depth and plan.bits is not None:
            level = [node for node in level if not _same_targets(*now[node], tree.stats[node], plan)]
        tables, pairs, below = now, {}, []
        chosen = [(node, reservoir(features, plan.per_node, rng.next_long()) if plan.per_node < features else list(range(features))) for node in level]
        for node, subset in chosen:
            f, cut, gain, left, right, stats, impurity = _best(tables[node][0], subset, tree.stats[node] if depth else None, tree.impurity[node], plan)
            tree.stats[node], tree.impurity[node] = stats, impurity
            if f is None:
                continue
            kids = [tree.add(s, float(_variance(s)) if plan.bits is None else 0.0) for s in (left, right)]
            tree.feature[node], tree.cut[node], tree.left[node], tree.gain[node] = f, cut, kids[0], gain
            pairs[node] = (kids[0], kids[1])
            if depth + 1 < plan.depth:
                below += [k for k in kids if plan.bits is not None or not abs(tree.impurity[k]) < PURE]
        level = below[::-1]
    return tree


# ---- all rows in one task -----------------------------------------------------------------------------------------------
@functools.lru_cache(maxsize=64)
def _draws(n: int) -> Draws:
    return Draws(n)


def sample(n: int, m: int, part: int, plan: Plan) -> np.ndarray:
    """Which rows of a partition are in the sample of round ``m``."""
    return _draws(n).below(plan.seed + m + part + 1, plan.rate) if plan.rate < 1 else np.ones(n, bool)


def fit_alone(parts: dict[int, np.ndarray], done: list[Tree], plan: Plan) -> Iterator[tuple[int, Tree, np.ndarray | None]]:
    """The trees after the ``done`` ones, and the sums of squares of their leaves, on the rows of all partitions."""
    order = sorted(parts)
    codes = np.concatenate([parts[p] for p in order], axis=1) if order else np.zeros((len(plan.splits), 0), np.uint8)
    score = np.zeros(codes.shape[1])
    for m in range(plan.rounds):
        if m < len(done):
            tree = done[m]
        else:
            keep = np.concatenate([sample(parts[p].shape[1], m, p, plan) for p in order]) if order else np.zeros(0, bool)
            x = np.ascontiguousarray(codes[:, keep])
            y, w = targets(x, score[keep], not m, plan)
            sums, node = sums_of(y, w, plan), np.zeros(x.shape[1], np.uint8)

            def count(tree, depth, slots, n):
                nonlocal node
                if depth:
                    node = Routes(tree).moved(x, node, depth - 1)
                return counted(x, sums, node, slots, n, plan)

            tree = grow(m, plan, count)
            squares = None if plan.bits is None else squares_of(Routes(tree).leaves(x), y, w, len(tree.left), plan)
            yield m, tree, squares
        routes = Routes(tree)
        score += routes.values.take(routes.leaves(codes)) * (plan.step if m else 1.0)


# ---- rows dealt to tasks ------------------------------------------------------------------------------------------------
class Kept:
    """What rounds made of the rows of one partition, in files of the executor (each is made again if it isn't there)."""

    def __init__(self, folder: str, part: int, codes: np.ndarray, plan: Plan, trees: list[Routes]):
        self.at, self.part, self.codes, self.plan, self.trees = f"{folder}/{part}", part, codes, plan, trees
        self.n = codes.shape[1]

    def _kept(self, name: str, kind: type, make: Callable[[], np.ndarray]) -> np.ndarray:
        try:
            return np.fromfile(f"{self.at}-{name}", kind)
        except FileNotFoundError:
            made = np.ascontiguousarray(make(), kind)
            own = f"{self.at}-{name}-{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(own), exist_ok=True)
            made.tofile(own)
            os.replace(own, f"{self.at}-{name}")
            return made

    def leaves(self, m: int) -> np.ndarray:
        """Every row's leaf in tree ``m``."""
        return self._kept(f"leaf-{m}", np.uint16, lambda: self.trees[m].leaves(self.codes))

    def score(self, m: int) -> np.ndarray:
        """After ``m`` trees."""

        def make():
            at = next((k for k in range(m - 1, 0, -1) if os.path.exists(f"{self.at}-score-{k}")), 0)
            score = np.fromfile(f"{self.at}-score-{at}", float) if at else np.zeros(self.n)
            for k in range(at, m):
                score += self.trees[k].values.take(self.leaves(k)) * (self.plan.step if k else 1.0)
            return score

        return self._kept(f"score-{m}", float, make) if m else np.zeros(self.n)

    def keep(self, m: int) -> np.ndarray:
        return self._kept(f"keep-{m}", bool, lambda: sample(self.n, m, self.part, self.plan))

    def sampled(self, m: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sampled rows' codes and what is summed of them."""
        keep = self.keep(m)
        x = self._kept(f"x-{m}", np.uint8, lambda: self.codes[:, keep]).reshape(len(self.codes), -1)
        made: list[np.ndarray] = []

        def make(k):
            if not made:
                made.extend(sums_of(*targets(x, self.score(m)[keep], not m, self.plan), self.plan))
            return made[k]

        return x, [self._kept(f"sum-{m}", float, lambda: make(0)), self._kept(f"mark-{m}", np.uint16, lambda: make(1)).astype(float)]

    def nodes(self, m: int, depth: int, routes: Routes, x: np.ndarray) -> np.ndarray:
        """The sampled rows' nodes at a level of the tree so far."""

        def make():
            if not depth:
                return np.zeros(x.shape[1], np.uint16)
            return routes.moved(x, self.nodes(m, depth - 1, routes, x), depth - 1)

        return self._kept(f"node-{m}-{depth}", np.uint16, make)

    def squares(self, m: int) -> np.ndarray:
        keep = self.keep(m)
        y, w = targets(self.codes[:, keep], self.score(m)[keep], not m, self.plan)
        return squares_of(self.leaves(m)[keep], y, w, len(self.trees[m].values), self.plan)

    def forget(self, m: int) -> None:
        for name in (f"leaf-{m}", f"score-{m}", f"keep-{m}", f"x-{m}", f"sum-{m}", f"mark-{m}", *(f"node-{m}-{d}" for d in range(self.plan.depth))):
            try:
                os.remove(f"{self.at}-{name}")
            except FileNotFoundError:
                pass


def _folder(token: str) -> str:
    return f"{tempfile.gettempdir()}/arledger-fit-{token}"


def fit_dealt(rows, done: list[Tree], plan: Plan) -> Iterator[tuple[int, Tree, np.ndarray | None]]:
    """As ``fit_alone``, on a persisted RDD of (partition, codes)."""
    sc, token, trees = rows.context, uuid.uuid4().hex, [Routes(t) for t in done]
    features = len(plan.splits)

    def job(known, m, depth, routes, slots, n):
        """The sums of squares of the tree before, when a round begins, and the counts of a level (none without ``routes``)."""

        def run(parts):
            own, squares = None, 0
            for part, data in parts:
                held = Kept(_folder(token), part, np.frombuffer(data, np.uint8).reshape(features, -1), plan, known.value)
                if not depth and m > len(done):
                    squares = squares + held.squares(m - 1)
                if routes is None:
                    continue
                x, sums = held.sampled(m)
                got = counted(x, sums, held.nodes(m, depth, routes, x), slots, n, plan)
                own = got if own is None else [a + b for a, b in zip(own, got, strict=True)]
                if depth == 1 and m:
                    held.forget(m - 1)
            yield pickle.dumps((own, squares), 5)

        total, squares = None, 0
        for own, of in map(pickle.loads, rows.mapPartitions(run).collect()):
            squares = squares + of
            if own is not None:
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        return total, squares

    last = None
    try:
        for m in range(len(done), plan.rounds + 1):
            known = sc.broadcast(trees)

            def count(tree, depth, slots, n, known=known, m=m):
                nonlocal last
                total, squares = job(known, m, depth, Routes(tree), slots, n)
                if not depth and last is not None:
                    last = (*last, squares)
                return total

            before = last
            if m < plan.rounds:
                tree = grow(m, plan, count)
            elif last is not None:
                last = (*last, job(known, m, 0, None, None, 0)[1])
            if before is not None:
                yield last
            if m < plan.rounds:
                last = (m, tree)
                trees.append(Routes(tree))
            known.destroy()
    finally:
        rows.mapPartitions(lambda parts: [shutil.rmtree(_folder(token), ignore_errors=True) for _ in parts]).count()


# ---- the fit as a Spark job ---------------------------------------------------------------------------------------------
def _object(name: str):
    """A Scala object of the JVM."""
    return SparkContext._active_spark_context._jvm.java.lang.Class.forName(f"{name}$").getField("MODULE$").get(None)


def _candidates(est: GBTClassifier, rows: DataFrame) -> tuple[list[list[float]], int]:
    """MLlib's candidate thresholds of every feature, and how many features a node may split on."""
    est._transfer_params_to_java()
    java, none = est._java_obj, _object("scala.collection.immutable.Nil").toMap(_object("scala.$less$colon$less").refl())
    algo = _object("org.apache.spark.mllib.tree.configuration.Algo").Classification()
    strategy = java.getOldBoostingStrategy(none, algo).treeStrategy()
    instances = _object("org.apache.spark.ml.util.DatasetUtils").extractInstances(java, rows._jdf, _object("scala.Option").apply(2))
    subset = est.getFeatureSubsetStrategy()
    metadata = _object("org.apache.spark.ml.tree.impl.DecisionTreeMetadata").buildMetadata(instances, strategy, 1, subset)
    found = _object("org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, metadata, est.getSeed())
    return [[s.threshold() for s in of] for of in found], metadata.numFeaturesPerNode()


def _binned(rows: DataFrame, splits: list[list[float]], features: list[str]) -> DataFrame:
    """Rows by partition, in their order: blocks of 2 * bin + label, one byte a feature."""
    source = rows.select(F.spark_partition_id().alias("part"), F.col("label").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    cuts = [np.array(s) for s in splits]

    def run(batches):
        seq = 0
        for batch in batches:
            if batch.num_rows:
                late = (batch.column(1).to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
                codes = np.stack([np.searchsorted(c, batch.column(2 + i).to_numpy(zero_copy_only=False), "left").astype(np.uint8) << 1 | late for i, c in enumerate(cuts)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([seq], pa.int32()), pa.array([codes.tobytes()], pa.binary())], ["part", "seq", "codes"])
                seq += 1

    return source.mapInArrow(run, "part int, seq int, codes binary")


class Fit:
    """A fit that can go on: the trees that an estimator's settings grow on ``rows`` (assembled, with label and weight)."""

    def __init__(self, est: GBTClassifier, rows: DataFrame, features: list[str]):
        self.spark, self.trees, self.plan = rows.sparkSession, [], None
        known = {r["label"]: r for r in rows.groupBy("label").agg(F.min("weight").alias("a"), F.max("weight").alias("z"), F.count(F.lit(1)).alias("n")).collect()}
        self.n = sum(r["n"] for r in known.values())
        self.own = bool(known) and all(r["a"] == r["z"] for r in known.values()) and est.getMaxBins() <= 120 and est.getMaxDepth() <= 14
        if not self.own:  # weights that labels don't tell, say: MLlib's own stages
            self.rows = rows
            return
        splits, per_node = _candidates(est, rows)
        self.blocks = stored(_binned(rows, splits, features), "binned")
        parts = self.blocks.select("part").distinct().count()
        weights = tuple(float(known[k]["a"]) if k in known else 1.0 for k in (0, 1))
        bits = None if parts <= 1 and self.n <= CHUNK_ROWS else 50 - math.ceil(math.log2(max(1.0, self.n * 4.0 * max(weights))))
        self.plan = Plan(splits, per_node, 0, est.getMaxDepth(), est.getStepSize(), est.getSubsamplingRate(), est.getMinInstancesPerNode(), est.getSeed(), weights, bits)
        self.parts = parts

    def _alone(self, plan: Plan, done: list[Tree]) -> list[tuple[int, Tree, np.ndarray | None]]:
        def run(batches):
            rows = sorted(((r["part"], r["seq"], r["codes"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
            parts: dict[int, list[np.ndarray]] = {}
            for part, _, codes in rows:
                parts.setdefault(part, []).append(np.frombuffer(codes, np.uint8).reshape(len(plan.splits), -1))
            for made in fit_alone({p: np.concatenate(c, axis=1) for p, c in parts.items()}, done, plan):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

        return [pickle.loads(r["made"]) for r in self.blocks.coalesce(1).mapInArrow(run, "made binary").collect()]

    def go_on(self, est: GBTClassifier) -> GBTClassificationModel:
        """The model with the estimator's number of rounds."""
        if not self.own:
            return est.fit(self.rows)
        plan, done = self.plan, list(self.trees)
        plan.rounds = est.getMaxIter()
        if self.n <= TASK_ROWS:
            made = self._alone(plan, done)
        else:
            tasks = max(1, min(self.parts, self.spark.sparkContext.defaultParallelism))
            dealt = self.blocks.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "seq")
            rows = dealt.rdd.mapPartitions(_joined(len(plan.splits))).persist(StorageLevel.MEMORY_AND_DISK)
            made = list(fit_dealt(rows, done, plan))
            rows.unpersist()
        for _, tree, squares in made:
            self.trees.append(tree if squares is None else _with_squares(tree, squares, plan))
        return _model(est, self.trees, plan, self.spark)


def _joined(features: int):
    """(partition, codes) of blocks that come in order."""

    def run(rows):
        last, parts = None, []
        for r in rows:
            if parts and r["part"] != last:
                yield last, np.concatenate(parts, axis=1).tobytes()
                parts = []
            last = r["part"]
            parts.append(np.frombuffer(r["codes"], np.uint8).reshape(features, -1))
        if parts:
            yield last, np.concatenate(parts, axis=1).tobytes()

    return run


def _with_squares(tree: Tree, squares: np.ndarray, plan: Plan) -> Tree:
    """The sums of squares and impurities of all nodes, from those of the leaves."""
    total = np.ldexp(squares, 2 - plan.bits)
    for node in range(len(tree.left) - 1, -1, -1):
        if tree.left[node] != node:
            total[node] = total[tree.left[node]] + total[tree.left[node] + 1]
        tree.stats[node] = np.append(tree.stats[node][:3], total[node])
        if tree.impurity[node] >= 0:
            tree.impurity[node] = max(0.0, float(_variance(tree.stats[node])))
    return tree


_NODE = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, " \
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"


def _node_rows(t: int, tree: Tree, plan: Plan) -> list[tuple]:
    """A tree as MLlib saves it: nodes in preorder; two leaves of equal predictions are one, as MLlib prunes."""
    values, rows = tree.values(), []

    def leaf(node):
        if tree.left[node] == node:
            return True
        a = tree.left[node]
        kids = leaf(a), leaf(a + 1)
        if all(kids) and values[a] == values[a + 1]:
            tree.left[node], tree.cut[node] = node, 255
            return True
        return False

    def put(node) -> int:
        here = len(rows)
        rows.append(None)
        s, a = tree.stats[node], tree.left[node]
        own = (float(values[node]), tree.impurity[node], [float(v) for v in s[1:4]], int(s[0]))
        if a == node:
            rows[here] = (t, (here, *own, -1.0, -1, -1, (-1, [], -1)))
        else:
            left, right = put(a), put(a + 1)
            rows[here] = (t, (here, *own, tree.gain[node], left, right, (tree.feature[node], [plan.splits[tree.feature[node]][tree.cut[node]]], -1)))
        return here

    leaf(0)
    put(0)
    return rows


def _model(est: GBTClassifier, trees: list[Tree], plan: Plan, spark: SparkSession) -> GBTClassificationModel:
    """MLlib's model of the trees, through its saved form (its settings from a model of as many single leaves)."""
    sc = spark.sparkContext
    jvm, new = sc._jvm, sc._gateway.new_array
    est._transfer_params_to_java()
    stats = new(jvm.double, 3)
    stats[0], stats[1], stats[2] = 1.0, 0.0, 0.0
    leaf = jvm.org.apache.spark.ml.tree.LeafNode(0.0, 0.0, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, 1))
    some, of = new(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees)), new(jvm.double, len(trees))
    for t in range(len(trees)):
        some[t] = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", leaf, len(plan.splits))
        of[t] = plan.step if t else 1.0
    empty = jvm.org.apache.spark.ml.classification.GBTClassificationModel(est.uid, some, of, len(plan.splits), 2).copy(est._java_obj.extractParamMap())
    path = f"{tables_dir(spark)}/model-{uuid.uuid4().hex[:12]}"
    empty.write().save(path)
    rows = [r for t, tree in enumerate(trees) for r in _node_rows(t, tree, plan)]
    spark.createDataFrame(rows, _NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
