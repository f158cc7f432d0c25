"""Gradient boosting of quantiles (pinball loss), one model per group of a grouped map.

Every (model, horizon, quantile) is a group of the rows of its series: a row per month, or per month and segment for
a pooled model. All groups are fitted in one Spark job, each in one task, whatever their number; a group is
bounded by the calendar (times the segments, if pooled), never by invoices.

A round fits a tree to the sign of the residuals: per feature, the rows of a node are counted by bin, all and those
that the prediction is not under. From these counts comes the gradient of any split (over - quantile * rows), and the
split of greatest gain is taken (ties: the first feature, the lowest cut). A leaf's value is the quantile of the
residuals of its rows, times the step. A fit ends when ``patience`` rounds in a row don't lower the loss of the
later rows (``is_train`` false), and keeps the rounds up to the lowest.

The models are rows: one per leaf, with the bounds on its path. ``predict`` joins rows with the leaves of their model, so
scoring is a join and a sum. Missing values are greater than any cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoostConfig:
    # FIXED VALUES: rounds, depth, leaves, step, patience, least rows of a leaf and bins of the published quantile models
    n_rounds: int = 300
    max_depth: int = 5
    max_leaves: int = 31
    step: float = 0.05
    patience: int = 50
    min_rows: int = 20
    max_bins: int = 255


MODEL = ["model", "horizon", "quantile"]
TREES = ("model string, horizon int, quantile double, tree int, value double, n_rows long, "
         "bounds array<struct<feature:int,lower:double,upper:double>>, test_loss double")

#: A leaf while its tree grows: the rows in it and the bounds on its path, by feature.
_Leaf = tuple[np.ndarray, dict[int, tuple[float, float]]]


def pinball(miss: np.ndarray, q: float) -> float:
    return float(np.where(miss >= 0, q * miss, (q - 1) * miss).mean()) if len(miss) else float("nan")


def bin_edges(values: np.ndarray, most: int) -> np.ndarray:
    """The upper ends of a feature's bins: its different values, or so many of them evenly spaced by rank."""
    known = np.sort(values[~np.isnan(values)])
    kinds = np.unique(known)
    return kinds if len(kinds) <= most else np.unique(known[np.linspace(0, len(known) - 1, most).astype(int)])


def best_split(codes: np.ndarray, over: np.ndarray, q: float, bins: int, min_rows: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split into codes up to the bin and above; gain 0 if there is none."""
    n, n_feat = codes.shape
    place = (codes + bins * np.arange(n_feat)).ravel()
    count = np.bincount(place, minlength=n_feat * bins).reshape(n_feat, bins).cumsum(1)
    above = np.bincount(place, np.repeat(over, n_feat), n_feat * bins).reshape(n_feat, bins).cumsum(1)
    left, right = above - q * count, (over.sum() - above) - q * (n - count)
    whole = over.sum() - q * n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * left / count + right * right / (n - count) - whole * whole / n
    gain = np.round(np.where((count >= min_rows) & (n - count >= min_rows), gain, 0.0), 9)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // bins, at % bins


def grow(codes: np.ndarray, edges: list[np.ndarray], over: np.ndarray, q: float, cfg: BoostConfig) -> list[_Leaf]:
    """The leaves of one tree over the rows of ``codes``, level by level."""
    bins = max(len(e) for e in edges) + 1
    done: list[_Leaf] = []
    level: list[_Leaf] = [(np.arange(len(codes)), {})]
    for _ in range(cfg.max_depth):
        found = [best_split(codes[rows], over[rows], q, bins, cfg.min_rows) for rows, _ in level]
        room = cfg.max_leaves - len(done) - len(level)
        chosen = sorted((i for i, f in enumerate(found) if f[0] > 0), key=lambda i: (-found[i][0], i))[: max(room, 0)]
        following: list[_Leaf] = []
        for i, (rows, box) in enumerate(level):
            if i not in chosen:
                done.append((rows, box))
                continue
            _, f, b = found[i]
            cut, (lo, hi) = float(edges[f][b]), box.get(f, (-np.inf, np.inf))
            goes_left = codes[rows, f] <= b
            following += [(rows[goes_left], {**box, f: (lo, min(hi, cut))}), (rows[~goes_left], {**box, f: (max(lo, cut), hi)})]
        level = following
    return done + level


def inside(x: np.ndarray, box: dict[int, tuple[float, float]]) -> np.ndarray:
    """The rows of ``x`` (missing values as infinity) in a leaf's bounds."""
    met = np.ones(len(x), bool)
    for f, (lo, hi) in box.items():
        met &= (x[:, f] > lo) & (x[:, f] <= hi)
    return met


def boost(x: np.ndarray, y: np.ndarray, is_train: np.ndarray, q: float, cfg: BoostConfig) -> Iterator[tuple[int, float, int, dict, float]]:
    """(tree, value, rows, bounds, loss of the later rows) of every leaf of the kept rounds; tree 0 is the start value."""
    train, later, target = x[is_train], np.where(np.isnan(x[~is_train]), np.inf, x[~is_train]), y[is_train]
    if not len(target):
        return
    edges = [bin_edges(train[:, f], cfg.max_bins) for f in range(x.shape[1])]
    codes = np.stack([np.where(np.isnan(train[:, f]), len(e), np.searchsorted(e, train[:, f])) for f, e in enumerate(edges)], axis=1)
    start = float(np.quantile(target, q))
    fitted, ahead = np.full(len(target), start), np.full(len(later), start)
    rounds = [[(start, len(target), {})]]
    losses = [pinball(y[~is_train] - ahead, q)]
    best = 0
    for k in range(1, cfg.n_rounds + 1):
        leaves = []
        residual, over = target - fitted, (fitted >= target).astype(float)
        for rows, box in grow(codes, edges, over, q, cfg):
            value = cfg.step * float(np.quantile(residual[rows], q))
            fitted[rows] += value
            ahead[inside(later, box)] += value
            leaves.append((value, len(rows), box))
        rounds.append(leaves)
        losses.append(pinball(y[~is_train] - ahead, q))
        if losses[k] < losses[best] or not len(later):
            best = k
        elif k - best >= cfg.patience:
            break
    for k in range(best + 1):
        for value, rows, box in rounds[k]:
            yield k, value, rows, box, losses[k]


def fit_models(rows: DataFrame, features: list[str], quantiles, cfg: BoostConfig | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """The trees of all models as one table. ``rows``: model, horizon, is_train, target and the features; ``order`` makes the
    order of a group's rows (and with it sums of equal rows) certain."""
    cfg = cfg or BoostConfig()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order)) if order else group
        model, horizon, q = key
        found = boost(group[features].to_numpy(float), group["target"].to_numpy(float), group["is_train"].to_numpy(bool), float(q), cfg)
        out = [(model, horizon, q, k, value, n, [(f, *box[f]) for f in sorted(box)], loss) for k, value, n, box, loss in found]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TREES.split(", ")])

    # a number of its own: Spark would merge these few bytes, and with them the fits, into one task
    return each.repartition(tasks, *MODEL).groupBy(*MODEL).applyInPandas(fit, TREES)


def predict(rows: DataFrame, trees: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(model, horizon, quantile, keep, prediction) for rows with a model and a horizon, one per quantile: the values
    of the leaves that a row is in, added in the order of the trees. ``keep`` tells a model's rows apart."""
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))), F.lit(float("inf"))) for c in features])
    source = rows.select("model", "horizon", *keep, x.alias("_x"))
    met = F.forall("bounds", lambda b: (F.get("_x", b["feature"]) > b["lower"]) & (F.get("_x", b["feature"]) <= b["upper"]))
    found = source.join(trees.select(*MODEL, "tree", "value", "bounds"), ["model", "horizon"]).where(met)
    listed = found.groupBy(*MODEL, *keep).agg(F.array_sort(F.collect_list(F.struct("tree", "value"))).alias("parts"))  # one a round
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["value"])
    return listed.select(*MODEL, *keep, total.alias("prediction"))
