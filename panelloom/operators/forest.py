"""Random regression forest: rows drawn by hash, trees grown from exact integer sums.

Every tree draws its rows from the whole table with replacement. A row's number of draws over
all trees follows a Poisson distribution, read off one hash, and each draw goes to a
tree of its own choice by hash; so each tree has independent Poisson weights, and in a large
table nearly every row costs one hash. `most_rows` is the expected size of a tree's sample,
which bounds a tree's task and the forest, however long the table is.

A tree grows level by level from the counts and sums of (node, feature, bin). Targets are
whole numbers of `UNITS` parts of their range, so sums are exact in any order and any
engine grows the same trees; bins are cut at order statistics of all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.operators.isolation import _digest, _number, _once
from panelloom.operators.quantiles import order_statistics

BINS = 64
UNITS = 1 << 30
MOST_NODES = 16_000_000   # twice the draws of a forest of the default size, and some more
TREES_PER_TASK = 25
PICKS = 4                 # trees that one hash chooses
AT_ONCE = 512             # nodes whose bins are counted together
NODES = ("tree int, node long, depth int, feature int, threshold double, rows long, total long, gain double, value double")


def draw_bounds(mean: float) -> list[int]:
    """Where a 52-bit number passes from k to k + 1 draws."""
    total, bounds = 0.0, []
    for k in range(int(mean + 12 * math.sqrt(mean) + 30)):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        bounds.append(int(total * (1 << 52)))
    return [b for b in bounds if b < 1 << 52]


def draws(ids: list[Column], trees: int, rate: float, seed: int) -> Column:
    """The trees that a row is drawn for, with repetition: Poisson of mean `rate` for each."""
    bounds = draw_bounds(trees * rate)

    def number(at):
        return F.when(at < bounds[0], 0).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= at)))

    def chosen(number):
        hashes = F.transform(F.sequence(F.lit(0), F.floor((number - 1) / PICKS).cast("int")),
                             lambda k: _digest(*ids, F.lit(seed), F.lit("draws"), k))
        picks = F.flatten(F.transform(hashes, lambda h: F.array(*[
            F.pmod(_number(F.substring(h, 8 * i + 1, 8), 8), F.lit(trees)).cast("int") for i in range(PICKS)])))
        return F.when(number > 0, F.slice(picks, F.lit(1), number))

    return _once(_once(_number(_digest(*ids, F.lit(seed)), 13), number), chosen)


def cut_points(rows: DataFrame, inputs: list[str], bins: int = BINS) -> list[list[float]]:
    """For each input the distinct values at evenly spaced ranks."""
    sizes, values = order_statistics(rows, inputs, [k / bins for k in range(1, bins)])
    return [sorted({values[c, math.floor(k / bins * (sizes[c] - 1))] for k in range(1, bins)}) if c in sizes else [] for c in inputs]


def _best(node: np.ndarray, count: int, bins: np.ndarray, y: np.ndarray, width: int):
    """Of each node the cut with the least squared error: (score, feature, bin); first by feature and bin."""
    features = bins.shape[1]
    score, place = np.full(count, -1.0), np.zeros(count, np.int64)
    order = np.argsort(node, kind="stable")
    edges = np.searchsorted(node[order], np.arange(0, count + AT_ONCE, AT_ONCE))
    for first, low, high in zip(range(0, count, AT_ONCE), edges, edges[1:]):
        some = order[low:high]
        shape = (min(AT_ONCE, count - first), features, width)
        cell = ((node[some] - first)[:, None] * features + np.arange(features)) * width + bins[some]
        n = np.bincount(cell.ravel(), minlength=math.prod(shape)).reshape(shape).cumsum(2).astype("float64")
        s = np.bincount(cell.ravel(), np.repeat(y[some], features), minlength=math.prod(shape)).reshape(shape).cumsum(2)
        right, rest = n[:, :, -1:] - n, s[:, :, -1:] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where((n > 0) & (right > 0), s * s / n + rest * rest / right, -1.0).reshape(shape[0], -1)
        place[first:first + shape[0]] = found.argmax(1)
        score[first:first + shape[0]] = found.max(1)
    return score, place // width, place % width


def tree(y: np.ndarray, bins: np.ndarray, cuts: list[list[float]], depth: int) -> pd.DataFrame:
    """Nodes of the regression tree that the rows grow, level by level; a leaf's feature is -1."""
    width = max(map(len, cuts)) + 1
    at, level, out = np.ones(len(y), np.int64), 0, []
    while len(y):
        places, node = np.unique(at, return_inverse=True)
        n = np.bincount(node).astype("float64")
        s = np.bincount(node, y)
        least, most = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        np.minimum.at(least, node, y)
        np.maximum.at(most, node, y)
        feature, cut, gain = np.full(len(n), -1), np.zeros(len(n), np.int64), np.zeros(len(n))
        if level < depth and (least < most).any():
            score, f, b = _best(node, len(n), bins, y, width)
            split = (least < most) & (score > s * s / n)
            feature[split], cut[split], gain[split] = f[split], b[split], (score - s * s / n)[split]
        out.append(pd.DataFrame({
            "node": places, "depth": level, "feature": feature, "cut": cut, "rows": n.astype("int64"), "total": s, "gain": gain,
            "threshold": [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist())]}))
        on = (feature >= 0)[node]
        node, y, bins = node[on], y[on], bins[on]
        goes_right = bins[np.arange(len(y)), feature[node]] > cut[node]
        at, level = 2 * places[node] + goes_right, level + 1
    return pd.concat(out, ignore_index=True)


def _binned(rows: pd.DataFrame, inputs: list[str], cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(t), rows[c].to_numpy(), "left") for c, t in zip(inputs, cuts)], axis=1)


def grow(inputs: list[str], cuts: list[list[float]], low: float, high: float, depth: int):
    """Grow one tree from its draws: columns tree, `_y` and the inputs."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        # Whole numbers, so sums are exact.
        found = tree(rows["_y"].to_numpy().astype("float64"), _binned(rows, inputs, cuts), cuts, depth)
        found = found.assign(tree=int(rows["tree"].iloc[0]), value=low + found["total"] / found["rows"] / UNITS * (high - low))
        found["total"] = found["total"].astype("int64")
        return found[["tree", "node", "depth", "feature", "threshold", "rows", "total", "gain", "value"]]

    return one


def boost(identity: list[str], target: str, inputs: list[str], cuts: list[list[float]], rounds: int, rate: float, depth: int,
          subsample: float, seed: int):
    """Boost one group of rows (column tree): node tables of its rounds, round 0 being the mean."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(identity, ignore_index=True)
        group, y, bins = int(rows["tree"].iloc[0]), rows[target].to_numpy(dtype="float64"), _binned(rows, inputs, cuts)
        rng = np.random.default_rng([seed, group])
        start = float(y.mean())
        now = np.full(len(y), start)
        out = [pd.DataFrame({"round": [0], "node": [1], "depth": [0], "feature": [-1], "threshold": [0.0], "value": [start]})]
        for k in range(1, rounds + 1):
            some = rng.random(len(y)) < subsample
            if not some.any():
                some[:] = True
            found = tree((y - now)[some], bins[some], cuts, depth)
            value = rate * (found["total"] / found["rows"]).to_numpy()
            feature, cut, places = (found[c].to_numpy() for c in ("feature", "cut", "node"))
            at = np.zeros(len(y), np.int64)  # row of the node table, the root first
            for _ in range(depth):
                inner = feature[at] >= 0
                side = bins[np.arange(len(y)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, np.searchsorted(places, 2 * places[at] + side), at)
            now = now + value[at]
            out.append(found[["node", "depth", "feature", "threshold"]].assign(round=k, value=value))
        return pd.concat(out, ignore_index=True).assign(tree=group)[["tree", "round", "node", "depth", "feature", "threshold", "value"]]

    return one


ROUNDS = "tree int, round int, node long, depth int, feature int, threshold double, value double"


def fit(rows: DataFrame, identity: list[str], target: str, inputs: list[str], trees: int, depth: int, most_rows: int, seed: int) -> DataFrame:
    """Node table of a forest on rows without nulls; a leaf's feature is -1."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("low"), F.max(target).alias("high")).first()
    if not first.n:
        return rows.sparkSession.createDataFrame([], NODES)
    cuts = cut_points(rows, inputs)
    part = (F.col(target) - first.low) / (first.high - first.low) if first.high > first.low else F.lit(0.0)
    drawn = rows.select(F.explode(draws([F.col(c) for c in identity], trees, min(1.0, most_rows / first.n), seed)).alias("tree"),
                        F.floor(part * UNITS).cast("long").alias("_y"), *[F.col(c).cast("double").alias(c) for c in inputs])
    spread = drawn.repartition(max(1, trees // TREES_PER_TASK), "tree")
    return spread.groupBy("tree").applyInPandas(grow(inputs, cuts, first.low, first.high, depth), NODES)


class Packed:
    """A node table as flat arrays; leaves point to themselves."""

    def __init__(self, nodes: DataFrame):
        if (n := nodes.count()) > MOST_NODES:
            raise ValueError(f"a forest of {n} nodes is too large to go along with the scoring code")
        held = nodes.select("tree", "node", "depth", "feature", "threshold", "value").toPandas().sort_values(["tree", "node"], ignore_index=True)
        key = (held["tree"].to_numpy().astype("int64") << 40) | held["node"].to_numpy()
        leaf = held["feature"].to_numpy() < 0
        here, tree, node = np.arange(len(held)), held["tree"].to_numpy().astype("int64") << 40, held["node"].to_numpy()
        self.left = np.where(leaf, here, np.searchsorted(key, tree | (2 * node))).astype("int32")
        self.right = np.where(leaf, here, np.searchsorted(key, tree | (2 * node + 1))).astype("int32")
        self.feature = np.where(leaf, 0, held["feature"]).astype("int16")
        self.threshold, self.value = held["threshold"].to_numpy(), held["value"].to_numpy()
        self.roots = np.flatnonzero(node == 1).astype("int32")
        self.depth = int(held["depth"].max()) if len(held) else 0

    def predict(self, x: np.ndarray, at_once: int = 2_000) -> np.ndarray:
        """Mean of the leaves' values; all trees in one step, some rows at a time."""
        out = np.zeros(len(x))
        for start in range(0, len(x), at_once):
            some = x[start:start + at_once]
            at = np.broadcast_to(self.roots, (len(some), len(self.roots)))
            rows = np.arange(len(some))[:, None]
            for _ in range(self.depth):
                at = np.where(some[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[start:start + len(some)] = self.value[at].mean(1)
        return out


def importance(nodes: DataFrame, inputs: list[str]) -> DataFrame:
    """(feature, importance): the shares of the gains in each tree, averaged over the trees with a split, in sum 1."""
    gains = nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    shares = gains.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    total = shares.agg(F.sum("share")).scalar()
    names = nodes.sparkSession.createDataFrame(list(enumerate(inputs)), "feature int, name string")
    return names.join(shares, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("share") / total, F.lit(0.0)).alias("importance")).orderBy(F.col("importance").desc(), "feature")
