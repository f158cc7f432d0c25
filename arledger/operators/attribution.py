"""Per-invoice feature attributions as a distributed Shapley job.

Contributions of the fitted trees are exact (``tree_shapley``): a leaf counts for a line x and a background row z
if each feature on its path is met by x or by z, and its part of the Shapley values depends only on which of them
x meets and which z meets. So the background is counted once per leaf, by the features that its rows meet, and a
line looks its parts up by those that it meets itself: the mean over all background rows and all permutations,
at the cost of one look-up per leaf.

Other scorers are sampled (``shapley``; Strumbelj & Kononenko 2014): for every (invoice line, sample) a seeded
feature permutation and a seeded background row z are drawn; the 13 "switch-on" points of the
permutation (first k features from x, the rest from z) are scored in one ``transform``. A point's
margin counts for the feature just switched on and against the next one, so the contributions are
plain signed sums per (line, feature): the points are made and scored row by row, the sums are
combined before their shuffle (one row per line is left), and no window over points is needed. A scorer that can
score numpy columns (``margins``) has its points made and scored batch by batch, without a row per point.
Per sample the contributions telescope to f(x) - f(z), so base + sum(phi) = f(x) exactly (base =
mean f(z) over the samples).

The sampled scorer is any function that adds a MARGIN to a ``features`` vector: the fitted trees, or
``linear_scorer``, for which the contributions are w * (x - mean z) whatever the permutations.
Contributions of the trees are on the uncalibrated margin (log-odds): columns ``phi_margin`` and
``base_margin``. ``phi_se`` is their standard error from the means of ``BATCHES`` groups of
samples (zero for a linear scorer with one background row, and for exact contributions). As noise raises the mean of
|phi_margin| whatever the number of lines, portfolio views need the exact ones. Row growth of the sampled ones is rows x samples x 13;
``n_samples`` is a parameter, and the error falls with its square root.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BACKGROUND_ROWS, FEATURE_COLS, RANDOM_SEED, TOP_N_RISKS
from ..session import stored, tables_dir
from .classify import TrainedClassifier, margin, tree_nodes

#: Key of an invoice line, and groups of samples that the standard error is taken from.
KEYS, BATCHES = ["BELNR", "BUZEI"], 4

Scorer = Callable[[DataFrame], DataFrame]


def line_keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


def linear_scorer(weights: list[float]) -> Scorer:
    """MARGIN = sum of weight * feature. ``margins`` is the same of numpy columns: [feature, row] to [row]."""

    def score(df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        total = F.lit(0.0)
        for j, w in enumerate(weights):
            total = total + F.lit(float(w)) * x[j]
        return df.withColumn("MARGIN", total)

    def margins(x: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape[1])
        for j, w in enumerate(weights):
            total = total + float(w) * x[j]
        return total

    score.margins = margins
    return score


def tree_scorer(model: TrainedClassifier) -> Scorer:
    return lambda df: margin(model.gbt.transform(df))


def background(fs: DataFrame, n: int = BACKGROUND_ROWS, seed: int = RANDOM_SEED,
               features: list[str] = FEATURE_COLS) -> DataFrame:
    """<= n rows chosen by a seeded hash order (a distributed top-k), indexed 0..n-1."""
    keys = line_keys(fs)
    order = [F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), *[F.col(k) for k in keys]]
    top = fs.orderBy(*order).limit(n)
    return top.select(
        *keys, (F.row_number().over(Window.orderBy(*order)) - 1).alias("bg_idx"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("z"),
    )


def shapley(scorer: Scorer, rows: DataFrame, bg: DataFrame, n_samples: int = 32, seed: int = RANDOM_SEED,
            feats: list[str] = FEATURE_COLS) -> tuple[DataFrame, DataFrame]:
    """Returns (long table keys, feature_idx, feature, phi_margin, phi_se; per-line table keys,
    base_margin, f_margin)."""
    margins = getattr(scorer, "margins", None)
    sums = _sums_in_batches(margins, rows, bg, n_samples, seed, feats) if margins else _sums_of_points(scorer, rows, bg, n_samples, seed, feats)
    keys, n_feat = line_keys(rows), len(feats)
    # a row per line; lines of one key count together
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in keys])
    batches = min(BATCHES, n_samples)
    size = [len(range(b, n_samples, batches)) for b in range(batches)]

    def error(j: int) -> Column:
        means = [F.col(f"b{b}_{j}") / F.lit(float(size[b])) for b in range(batches)]
        centre = sum(means, F.lit(0.0)) / F.lit(float(batches))
        spread = sum(((m - centre) * (m - centre) for m in means), F.lit(0.0))
        return F.sqrt(spread / F.lit(float(max(1, batches * (batches - 1)))))

    n = F.lit(float(n_samples))
    done = stored(total.select(
        *keys, F.array(*[F.col(f"v{j}") / n for j in range(n_feat)]).alias("phi"), F.array(*[error(j) for j in range(n_feat)]).alias("se"),
        (F.col("start") / n).alias("base_margin"), (F.col("end") / n).alias("f_margin")), "shapley-lines")
    return _long(done, feats), done.select(*keys, "base_margin", "f_margin")


def _draws(rows: DataFrame, n_bg: Column, s: Column, seed: int, n_feat: int) -> tuple[Column, list[Column]]:
    """The background row of sample ``s`` of a line, and the numbers whose order is its permutation (ties by feature)."""
    ids = [F.col(k) for k in line_keys(rows)]
    return (F.pmod(F.xxhash64(*ids, s, F.lit(seed)), n_bg).cast("int"), [F.xxhash64(*ids, s, F.lit(j), F.lit(seed + 1)) for j in range(n_feat)])


def _sums_in_batches(margins: Callable[[np.ndarray], np.ndarray], rows: DataFrame, bg: DataFrame, n_samples: int, seed: int, feats: list[str]) -> DataFrame:
    """The sums of ``_sums_of_points`` for a scorer of numpy columns: all points of a batch of lines are made and scored
    in the task that reads them, so a line stays one row."""
    keys, n_feat, batches = line_keys(rows), len(feats), min(BATCHES, n_samples)
    zs = sorted((r["bg_idx"], r["z"]) for r in bg.select("bg_idx", F.transform("z", lambda v: F.coalesce(v, F.lit(0.0))).alias("z")).collect())  # at most BACKGROUND_ROWS rows
    z = np.array([v for _, v in zs], dtype=np.float64).reshape(-1, n_feat).T
    drawn = [_draws(rows, F.lit(len(zs)).cast("bigint"), F.lit(s), seed, n_feat) for s in range(n_samples)]
    # a missing feature is 0, as in a vector made of an array
    source = rows.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(feats)],
                         *[c.alias(f"d{s}_{i}") for s, (at, order) in enumerate(drawn) for i, c in enumerate([at, *order])])
    names = [*[f"v{j}" for j in range(n_feat)], "start", "end", *[f"b{b}_{j}" for b in range(batches) for j in range(n_feat)]]

    def run(found):
        for batch in found:
            n, at = batch.num_rows, len(keys)
            if not n:
                continue
            column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
            x = np.stack([column(at + j) for j in range(n_feat)])
            line, total, by_batch = np.arange(n), np.zeros((n_feat, n)), np.zeros((batches, n_feat, n))
            start, end = np.zeros(n), np.zeros(n)
            for s in range(n_samples):
                first = at + n_feat + s * (n_feat + 1)
                order = np.argsort(np.stack([column(first + 1 + j) for j in range(n_feat)]), axis=0, kind="stable")
                point = z[:, column(first)]
                before = margins(point)
                start += before
                for turn in order:  # the feature of each line that is switched on
                    point[turn, line] = x[turn, line]
                    after = margins(point)
                    for part in (total, by_batch[s % batches]):  # point by point, as sums of rows go
                        part[turn, line] -= before
                        part[turn, line] += after
                    before = after
                end += before
            sums = [*total, start, end, *by_batch.reshape(-1, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *map(pa.array, sums)], [*keys, *names])

    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, {', '.join(f'{c} double' for c in names)}")


def _sums_of_points(scorer: Scorer, rows: DataFrame, bg: DataFrame, n_samples: int, seed: int, feats: list[str]) -> DataFrame:
    """Sums over a line's samples: v<feature> of the contributions, b<batch>_<feature> of those of a batch of samples,
    start and end of the margins of the background row and of the line itself."""
    keys = line_keys(rows)
    n_feat = len(feats)
    n_bg = bg.agg(F.count(F.lit(1))).scalar()
    ids = [F.col(k) for k in keys]
    x = rows.select(*keys, F.array(*[F.col(c).cast("double") for c in feats]).alias("x"))
    s = x.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("s"))
    s = s.withColumn("bg_idx", F.pmod(F.xxhash64(*ids, F.col("s"), F.lit(seed)), n_bg).cast("int"))
    # the background has at most BACKGROUND_ROWS rows: broadcast is bounded
    s = s.join(F.broadcast(bg.select("bg_idx", "z")), "bg_idx").drop("bg_idx")
    each = F.sequence(F.lit(0), F.lit(n_feat - 1))
    drawn = F.transform(each, lambda j: F.struct(F.xxhash64(*ids, F.col("s"), j, F.lit(seed + 1)).alias("h"), j.alias("j")))
    s = s.withColumn("perm", F.transform(F.array_sort(drawn), lambda e: e["j"]))  # perm[k] = feature at position k
    s = s.withColumn("rank", F.transform(each, lambda j: F.array_position(F.col("perm"), j) - 1))
    pts = s.select(*keys, "s", "x", "z", "perm", "rank", F.explode(F.sequence(F.lit(0), F.lit(n_feat))).alias("k"))
    vec = F.transform(each, lambda j: F.when(F.col("rank")[j] < F.col("k"), F.col("x")[j]).otherwise(F.col("z")[j]))
    scored = scorer(pts.withColumn("features", array_to_vector(vec)))
    m, k = F.col("MARGIN"), F.col("k")
    before, after = F.when(k > 0, F.col("perm")[k - 1]), F.when(k < n_feat, F.col("perm")[k])
    batches = min(BATCHES, n_samples)
    part = scored.select(*keys, "s", before.alias("_on"), after.alias("_off"), m.alias("m"), k.alias("k"))
    of = [F.when(F.col("_on") == j, F.col("m")).when(F.col("_off") == j, -F.col("m")) for j in range(n_feat)]
    return part.groupBy(*keys).agg(
        *[F.sum(of[j]).alias(f"v{j}") for j in range(n_feat)],
        F.sum(F.when(F.col("k") == 0, F.col("m"))).alias("start"), F.sum(F.when(F.col("k") == n_feat, F.col("m"))).alias("end"),
        *[F.sum(F.when(F.col("s") % batches == b, of[j])).alias(f"b{b}_{j}") for b in range(batches) for j in range(n_feat)])


def _long(lines: DataFrame, feats: list[str]) -> DataFrame:
    """The long table of a stored table of lines (keys, phi and se as arrays), which stays at hand for reports that
    join lines: they join one row a line, not one a feature."""
    names = F.array(*[F.lit(c) for c in feats])
    each = lines.select(*line_keys(lines), F.posexplode(F.arrays_zip("phi", "se")).alias("feature_idx", "_p"))
    phi = each.select(*line_keys(lines), "feature_idx", F.element_at(names, F.col("feature_idx") + 1).alias("feature"),
                      F.col("_p.phi").alias("phi_margin"), F.col("_p.se").alias("phi_se"))
    phi._lines = (lines, feats)
    return phi


def join_lines(phi: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``phi.join(other, on)``: the lines are joined before they become a row a feature, if they are at hand."""
    found = getattr(phi, "_lines", None)
    if found is None:
        return phi.join(other, on)
    lines, feats = found
    rest = [c for c in [*line_keys(lines), *other.columns] if c not in on]
    joined = lines.select(*line_keys(lines), "phi", "se").join(other, on)
    names = F.array(*[F.lit(c) for c in feats])
    each = joined.select(*on, *rest, F.posexplode(F.arrays_zip("phi", "se")).alias("feature_idx", "_p"))
    own = [c for c in rest if c in line_keys(lines)]
    return each.select(*on, *own, "feature_idx", F.element_at(names, F.col("feature_idx") + 1).alias("feature"), F.col("_p.phi").alias("phi_margin"),
                       F.col("_p.se").alias("phi_se"), *[c for c in rest if c not in own])


def feature_means(lines: DataFrame, feats: list[str], value: Callable[[Column], Column], name: str, by: list[str]) -> DataFrame:
    """(by, feature, mean of ``value`` of the contributions) of a table of lines: a line stays one row, only the means become
    a row a feature."""
    means = [F.avg(value(F.get("phi", F.lit(j)))).alias(f"_m{j}") for j in range(len(feats))]
    wide = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *means).where(F.col("_n") > 0)
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m{j}").alias(name)) for j, c in enumerate(feats)])))


def of_feature(phi: DataFrame, feature: Column | str) -> DataFrame:
    """keys, feature, phi_margin of one feature, a name or a scalar of the plan."""
    feature = F.lit(feature) if isinstance(feature, str) else feature
    found = getattr(phi, "_lines", None)
    if found is None:
        return phi.where(F.col("feature") == feature).select(*line_keys(phi), "feature", "phi_margin")
    lines, feats = found
    at = F.array_position(F.array(*[F.lit(c) for c in feats]), F.col("feature")).cast("int") - 1
    return lines.withColumn("feature", feature).where(F.col("feature").isin(*feats)).select(
        *line_keys(lines), "feature", F.get("phi", at).alias("phi_margin"))


#: A leaf: margin, features on its path, lower and upper bounds. A row is in it if lower < value <= upper for all.
Leaf = tuple[float, list[int], np.ndarray, np.ndarray]


def tree_leaves(trees: list[tuple[float, dict]]) -> list[Leaf]:
    """The leaves of (weight, nodes) trees, as ``classify.tree_nodes`` reads them."""
    leaves = []
    for weight, nodes in trees:
        todo = [(0, {})]
        while todo:
            at, box = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                feats = sorted(box)
                lower, upper = (np.array([box[f][i] for f in feats]) for i in (0, 1))
                leaves.append((2 * weight * node["prediction"], feats, lower, upper))
                continue
            f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            lo, hi = box.get(f, (-np.inf, np.inf))
            todo.append((node["leftChild"], {**box, f: (lo, min(hi, cut))}))
            todo.append((node["rightChild"], {**box, f: (max(lo, cut), hi)}))
    return leaves


def _ordered(values: np.ndarray) -> np.ndarray:
    """Feature rows as comparisons take them: a missing value is never below a threshold."""
    return np.maximum(np.where(np.isnan(values), np.inf, values), -np.finfo(np.float64).max)


def leaf_parts(d: int) -> np.ndarray:
    """[met by x, met by z, feature]: Shapley values of a leaf of margin 1 with d features, by the sets of them
    that x and z meet (as bits)."""
    full = (1 << d) - 1
    parts = np.zeros((full + 1, full + 1, d))
    for x in range(full + 1):
        for z in range(full + 1):
            if x | z != full:
                continue
            u, v = d - z.bit_count(), d - x.bit_count()  # met by x only, by z only
            for j in range(d):
                if not z >> j & 1:
                    parts[x, z, j] = factorial(u - 1) * factorial(v) / factorial(u + v)
                elif not x >> j & 1:
                    parts[x, z, j] = -factorial(u) * factorial(v - 1) / factorial(u + v)
    return parts


#: Comparisons that leaves share one look-up by (four leaves of a common node at depth 4 need seven), unless one leaf has more.
LOOKUP_BOUNDS = 7


def _bounds(leaf: Leaf) -> list[tuple[int, float]]:
    """The (feature, bound) that a row is compared with to be in a leaf: above the lower ones, not above the upper ones."""
    _, on, lower, upper = leaf
    return [(f, b) for j, f in enumerate(on) for b, none in ((float(lower[j]), -np.inf), (float(upper[j]), np.inf)) if b != none]


def leaf_lookups(leaves: list[Leaf], parts: list[np.ndarray]) -> list[tuple[list[tuple[int, float]], list[int], np.ndarray]]:
    """Leaves that follow each other and are compared with few bounds, as one look-up: (bounds, features, table). The table
    has a row a feature and one for the margin, by the bounds that a line isn't above (as bits). ``parts``: a leaf's
    contributions by feature and by the features that a line meets."""
    groups: list[tuple[dict[tuple[int, float], int], list[int]]] = []
    for i, leaf in enumerate(leaves):
        mine = _bounds(leaf)
        if not groups or len(groups[-1][0].keys() | set(mine)) > LOOKUP_BOUNDS:
            groups.append(({}, []))
        bounds, members = groups[-1]
        for b in mine:
            bounds.setdefault(b, len(bounds))
        members.append(i)
    found = []
    for bounds, members in groups:
        under = np.arange(1 << len(bounds))[:, None] >> np.arange(len(bounds)) & 1 == 1
        feats = sorted({f for f, _ in bounds})
        table = np.zeros((len(feats) + 1, len(under)))
        for i in members:
            value, on, lower, upper = leaves[i]
            met = np.zeros(len(under), np.int64)
            for j, f in enumerate(on):
                inside = np.ones(len(under), bool)
                if lower[j] != -np.inf:
                    inside &= ~under[:, bounds[f, float(lower[j])]]
                if upper[j] != np.inf:
                    inside &= under[:, bounds[f, float(upper[j])]]
                met |= inside.astype(np.int64) << j
            for j, f in enumerate(on):
                table[feats.index(f)] += parts[i][j][met]
            table[-1] += np.where(met == (1 << len(on)) - 1, value, 0.0)
        found.append((list(bounds), feats, table))
    return found


def model_shapley(model: TrainedClassifier, rows: DataFrame, bg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X2 of a fitted model."""
    return tree_shapley(tree_leaves(tree_nodes(model.gbt, rows.sparkSession)), rows, bg, model.config.features)


def tree_shapley(leaves: list[Leaf], rows: DataFrame, bg: DataFrame, feats: list[str] = FEATURE_COLS) -> tuple[DataFrame, DataFrame]:
    """X2, exact for the leaves of any trees and the whole background: the tables of ``shapley``, ``phi_se`` being 0."""
    keys = line_keys(rows)
    spark = rows.sparkSession
    z = _ordered(np.array([r["z"] for r in bg.select("z").collect()], dtype=np.float64).reshape(-1, len(feats)))  # at most BACKGROUND_ROWS rows
    parts: dict[int, np.ndarray] = {}
    base, by_leaf = 0.0, []
    for value, on, lower, upper in leaves:
        d = len(on)
        met = (((z[:, on] > lower) & (z[:, on] <= upper)) << np.arange(d)).sum(1)
        share = np.bincount(met, minlength=1 << d) / len(z) * value
        base += float(share[-1])
        if d not in parts:
            parts[d] = leaf_parts(d)
        by_leaf.append(np.einsum("xzj,z->jx", parts[d], share))  # feature by pattern of the line
    lookups, n_feat, block = spark.sparkContext.broadcast(leaf_lookups(leaves, by_leaf)), len(feats), 4096

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.ascontiguousarray(np.array([batch.column(len(keys) + j).to_numpy(zero_copy_only=False) for j in range(n_feat)], dtype=np.float64).reshape(n_feat, n))
            x = np.maximum(np.where(np.isnan(x), np.inf, x), -np.finfo(np.float64).max)
            phi, f = np.zeros((n_feat, n)), np.zeros(n)
            for start in range(0, n, block):
                end = min(n, start + block)
                for bounds, on, table in lookups.value:
                    bits = np.zeros(end - start, np.uint8 if len(bounds) <= 8 else np.int64)
                    for k, (feature, bound) in enumerate(bounds):
                        bits |= (x[feature, start:end] <= bound).astype(bits.dtype) << k
                    at = bits.astype(np.intp)
                    for j, feature in enumerate(on):
                        phi[feature, start:end] += table[j].take(at)
                    f[start:end] += table[-1].take(at)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(phi.T).ravel()), n_feat).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), lists, pa.array(f)], [*keys, "phi", "f"])

    source = rows.select(*keys, *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(feats)])
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    done = stored(source.mapInArrow(run, f"{kinds}, phi array<double>, f double"), "shapley-exact")
    lookups.unpersist()
    exact = done.withColumn("se", F.transform("phi", lambda _: F.lit(0.0)))
    return _long(exact, feats), done.select(*keys, F.lit(base).alias("base_margin"), F.col("f").alias("f_margin"))


def with_error(result: DataFrame, phi: DataFrame) -> DataFrame:
    """A report on contributions with the largest standard error among them (0: they are exact)."""
    found = getattr(phi, "_lines", None)
    largest = phi.agg(F.max("phi_se")) if found is None else found[0].agg(F.max(F.array_max("se")))
    return result.withColumn("max_phi_se", largest.scalar())


def phi_array(phi: DataFrame, n_feat: int = len(FEATURE_COLS)) -> DataFrame:
    """Long contributions -> one array per invoice in feature order (SHAP_VALUES)."""
    return phi.groupBy(*line_keys(phi)).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("feature_idx", "phi_margin"))), lambda e: e["phi_margin"]
        ).alias("SHAP_VALUES")
    ).where(F.size("SHAP_VALUES") == n_feat)


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, ranked."""
    found = getattr(phi, "_lines", None)
    if found is None:
        agg = phi.groupBy("feature").agg(F.avg(F.abs("phi_margin")).alias("mean_abs_phi"))
    else:
        agg = feature_means(*found, F.abs, "mean_abs_phi", [])
    return agg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_phi"), "feature")))


def waterfall(phi: DataFrame, rows: DataFrame, top: int = 8, features: list[str] = FEATURE_COLS) -> DataFrame:
    """Per invoice the 8 largest |contribution| with the feature value and sign."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    keys = line_keys(phi)
    vals = rows.select(*keys, F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))
    j = phi.join(vals, [*keys, "feature"])
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("phi_margin")), "feature"))
    return j.withColumn("position", r).where(F.col("position") <= top).select(
        *keys, "position", "feature", "value", "phi_margin",
        F.when(F.col("phi_margin") > 0, "increases risk").otherwise("reduces risk").alias("direction"),
    )


def contributions_by_tier(phi: DataFrame, fs: DataFrame) -> DataFrame:
    """Mean contribution per (risk tier, feature)."""
    keys = line_keys(phi)
    tiers = fs.select(*keys, "RISK_TIER")
    found = getattr(phi, "_lines", None)
    if found is None:
        return phi.join(tiers, keys).groupBy("RISK_TIER", "feature").agg(F.avg("phi_margin").alias("mean_phi"))
    lines, feats = found
    return feature_means(lines.select(*keys, "phi").join(tiers, keys), feats, lambda phi: phi, "mean_phi", ["RISK_TIER"])


def dependence(phi: DataFrame, fs: DataFrame, feature: str, interaction: str) -> DataFrame:
    """(value, contribution, interacting value) triples for one feature."""
    keys = line_keys(phi)
    return of_feature(phi, feature).join(
        fs.select(*keys, F.col(feature).cast("double").alias("value"),
                  F.col(interaction).cast("double").alias("interaction_value")), keys
    ).select(*keys, F.lit(feature).alias("feature"), "value", "phi_margin",
             F.lit(interaction).alias("interaction"), "interaction_value")


#: Rows of one run of the ordered feature (fewer if there are few rows), and a deviation that counts as none.
RUN_ROWS, NO_SPREAD = 50, 1e-12


def interaction_strengths(phi: DataFrame, fs: DataFrame, feature: Column, features: list[str] = FEATURE_COLS) -> DataFrame:
    """(interaction, strength) of every other feature with ``feature``. The lines are ordered by the feature's value
    (ties by key) and cut into runs of min(rows / 10, ``RUN_ROWS``); inside a run the feature hardly changes, so
    what its contribution still varies with is another feature: the strength is the sum over the runs of the
    |correlation| of the contribution with the other feature.

    The place of a line in the order comes from its place in a stored range partition and the sizes of the
    partitions before it; correlations are grouped sums, so no run and no partition of lines goes through
    the driver. ``feature`` may be a scalar of the plan."""
    keys = line_keys(phi)
    values = F.array(*[F.round(F.col(c).cast("double"), 6) for c in features])
    lines = of_feature(phi, feature).select(*keys, "feature", F.round("phi_margin", 9).alias("_phi"))
    lines = lines.join(fs.select(*keys, values.alias("_x")), keys)
    index = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature")).cast("int") - 1
    # the feature goes on by its number: an aggregate that keeps a string is one of sorts, not of hashes
    lines = lines.select(*keys, index.alias("_f"), "_phi", "_x", F.get("_x", index).alias("_v"))
    order = [F.asc_nulls_last("_v"), *[F.asc(k) for k in keys]]
    parts = int(phi.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(lines.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()), "interaction-lines")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_pid").orderBy(*order))).join(F.broadcast(before), "_pid")
    size = F.greatest(F.least(F.floor(F.col("_all") / F.lit(10)), F.lit(RUN_ROWS)), F.lit(1))
    runs = placed.withColumn("_run", F.floor((F.col("_before") + F.col("_at") - 1) / size))
    spread = [F.stddev_pop("_phi"), *[F.stddev_pop(F.get("_x", F.lit(i))) for i in range(len(features))]]
    per_run = runs.groupBy("_run").agg(
        F.first("_f").alias("_f"), F.array(*[F.covar_pop("_phi", F.get("_x", F.lit(i))) for i in range(len(features))]).alias("_cov"), F.array(*spread).alias("_sd"))
    names = F.array(*[F.lit(c) for c in features])
    long = per_run.select("_f", "_sd", F.posexplode("_cov").alias("_i", "_c")).withColumn("interaction", F.get(names, F.col("_i")))
    own, its = F.get("_sd", F.lit(0)), F.get("_sd", F.col("_i") + 1)
    strength = F.sum(F.when((own > NO_SPREAD) & (its > NO_SPREAD), F.abs(F.col("_c") / (own * its))).otherwise(F.lit(0.0)))
    return long.where(F.col("_i") != F.col("_f")).groupBy("interaction").agg(F.bround(strength, 6).alias("strength"))


def top_dependence(phi: DataFrame, fs: DataFrame, features: list[str] = FEATURE_COLS) -> DataFrame:
    """X9 for the feature of greatest mean |contribution|: its value and contribution, and the name and value of the
    feature that it interacts with most (``interaction_strengths``; ties by name). Both features are found in
    the same plan (scalars), their values picked by name."""
    keys = line_keys(phi)
    top = stored(global_importance(phi).where("rank = 1").select("feature"), "top-feature").scalar()  # one row, measured once
    strengths = stored(interaction_strengths(phi, fs, top, features), "interactions")  # a row per feature
    other = strengths.orderBy(F.desc("strength"), "interaction").limit(1).select("interaction").scalar()

    def value(name: Column) -> Column:  # picked before the join: a line takes two numbers there, not all features
        picked = F
        for c in features:
            picked = picked.when(name == c, F.col(c).cast("double"))
        return picked

    vals = fs.select(*keys, value(top).alias("value"), value(other).alias("interaction_value"))
    return of_feature(phi, top).join(vals, keys).withColumn("interaction", other).select(
        *keys, "feature", "value", "phi_margin", "interaction", "interaction_value")


def extremes(scored: DataFrame) -> DataFrame:
    """The single highest- and lowest-risk invoices (ties by BELNR)."""
    hi = scored.orderBy(F.desc("LATE_PROB"), "BELNR").limit(1).withColumn("which", F.lit("highest"))
    lo = scored.orderBy(F.asc("LATE_PROB"), "BELNR").limit(1).withColumn("which", F.lit("lowest"))
    return hi.unionByName(lo)


def top_flagged(scored: DataFrame, n: int = TOP_N_RISKS) -> DataFrame:
    """X7 selection: flagged invoices, highest probability first (ties by BELNR), top n."""
    return scored.where(F.col("LATE_PRED") == 1).orderBy(F.desc("LATE_PROB"), "BELNR").limit(n)


# FIXED VALUES: feature groups of the audit checks
PAYMENT_FEATURES = ["CUST_AVG_DAYS_LATE", "CUST_LATE_RATE", "CUST_INVOICE_COUNT", "CUST_AVG_AMOUNT"]


def audit_checks(phi: DataFrame, scored: DataFrame) -> DataFrame:
    """X11: six policy checks as one table (name, applicable, ok, status, detail)."""
    imp = global_importance(phi)
    total = F.sum("mean_abs_phi")
    shares = imp.agg(
        F.count_if((F.col("rank") <= 5) & F.col("feature").isin(*PAYMENT_FEATURES)).alias("top5_payment"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "feature")))),
                                 lambda e: e["feature"]), ",").alias("top5"),
        (F.sum(F.when(F.col("feature").isin(*PAYMENT_FEATURES), F.col("mean_abs_phi"))) / F.greatest(total, F.lit(1e-12))).alias("pay_share"),
        (F.max("mean_abs_phi") / F.greatest(total, F.lit(1e-12))).alias("dom_share"),
        F.max_by("feature", F.struct(F.col("mean_abs_phi"), -F.col("rank"))).alias("dom_feature"),
    )
    tiers = scored.agg(
        F.count_if(F.col("RISK_TIER") == "High").alias("high_n"),
        F.count_if(F.col("RISK_TIER") == "Low").alias("low_n"),
        F.avg(F.when(F.col("RISK_TIER") == "High", F.col("LATE_PROB"))).alias("high_prob"),
        F.avg(F.when(F.col("RISK_TIER") == "Low", F.col("LATE_PROB"))).alias("low_prob"),
        F.avg(F.when(F.col("RISK_TIER") == "High", F.col("LATE_PRED"))).alias("high_flag"),
        F.avg("LATE_PRED").alias("flag_rate"),
        F.avg("LATE_PROB").alias("mean_prob"),
        F.avg("LATE_FLAG").alias("late_rate"),
    )
    # one row each, measured once: every scalar of the plan reads the stored row
    shares, tiers = stored(shares, "audit-shares"), stored(tiers, "audit-tiers")
    s = {c: shares.select(c).scalar() for c in shares.columns}
    t = {c: tiers.select(c).scalar() for c in tiers.columns}
    gap = F.abs(t["mean_prob"] - t["late_rate"])
    tier_ok = (t["high_n"] >= 100) & (t["low_n"] >= 100)
    flag_ok = (t["flag_rate"] > 0.02) & (t["flag_rate"] < 0.98) & (t["high_n"] >= 100)

    # a tier without rows has no mean: shown as n/a instead of blanking the text
    f4 = lambda c: F.coalesce(F.format_string("%.4f", F.bround(c, 4)), F.lit("n/a"))
    count = lambda c: c.cast("string")
    few = F.concat(F.lit("skipped: high_n="), count(t["high_n"]), F.lit("; low_n="), count(t["low_n"]), F.lit("; each must be 100 or more"))
    one_sided = F.concat(F.lit("skipped: overall_flag_rate="), f4(t["flag_rate"]), F.lit("; high_n="), count(t["high_n"]),
                         F.lit("; needs a rate within (0.02, 0.98) and 100 rows"))

    def row(name, applicable, ok, detail, skipped=F.lit("")):
        applicable = applicable if hasattr(applicable, "alias") else F.lit(applicable)
        ok_col = F.coalesce(F.when(applicable, ok).otherwise(F.lit(True)), F.lit(False))
        status = F.when(~applicable, "SKIP").when(ok_col, "PASS").otherwise("FAIL")
        return F.struct(F.lit(name).alias("name"), applicable.alias("applicable"), ok_col.alias("ok"),
                        status.alias("status"), F.when(applicable, detail).otherwise(skipped).alias("detail"))

    checks = F.array(
        row("Top-5 include at least two payment behavior features", True, s["top5_payment"] >= 2,
            F.concat(F.lit("top5="), s["top5"], F.lit("; payment_count="), s["top5_payment"].cast("string"))),
        row("Payment behavior features contribute at least 35% of total attribution", True, s["pay_share"] >= 0.35,
            F.concat(F.lit("payment_share="), f4(s["pay_share"]), F.lit("; threshold=0.3500"))),
        row("High-risk tier has higher avg LATE_PROB than low-risk tier", tier_ok, t["high_prob"] > t["low_prob"],
            F.concat(F.lit("high_n="), t["high_n"].cast("string"), F.lit("; low_n="), t["low_n"].cast("string"),
                     F.lit("; high_mean_prob="), f4(t["high_prob"]), F.lit("; low_mean_prob="), f4(t["low_prob"])), few),
        row("High-risk flag rate is above overall flag rate", flag_ok, t["high_flag"] > t["flag_rate"],
            F.concat(F.lit("high_flag_rate="), f4(t["high_flag"]), F.lit("; overall_flag_rate="), f4(t["flag_rate"])), one_sided),
        row("Portfolio calibration gap is below 0.10", True, gap < 0.10,
            F.concat(F.lit("mean_prob="), f4(t["mean_prob"]), F.lit("; actual_late_rate="), f4(t["late_rate"]),
                     F.lit("; gap="), f4(gap), F.lit("; threshold=0.1000"))),
        row("No single feature dominates with >60% of total attribution", True, s["dom_share"] < 0.60,
            F.concat(F.lit("dominant_feature="), s["dom_feature"], F.lit("; dominant_feature_share="), f4(s["dom_share"]),
                     F.lit("; threshold=0.6000"))),
    )
    return scored.sparkSession.range(1).select(F.explode(checks).alias("c")).select("c.*")
