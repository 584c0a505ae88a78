"""Isolation forest: trees grown on hashed samples, rows scored in Arrow batches."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.functions.exprs import score_severity
from panelloom.operators.derive import scale_apply, scale_fit
from panelloom.operators.quantiles import quantile_row
from panelloom.sources.storage import stage
from panelloom.spec import ANOMALY_FEATURES, PanelSpec

TREES, SAMPLE, CONTAMINATION, SEED = 200, 256, 0.05, 42
TREES_PER_TASK = 25
SPARE = 1.5             # rows that enter a tree, for each one that it keeps
MOST_NODES = 1_000_000
ROWS_AT_ONCE = 2_000
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, "
               "left int, right int, size int, depth int")
_Z = "_z_"


@dataclass(frozen=True)
class IsolationModel:
    """A fitted forest. Each part is a small frame: nodes, scaler row, cut-off row."""

    nodes: DataFrame       # at most trees * (2 * sample - 1) rows
    scaler: DataFrame      # one row
    cutoff: DataFrame      # one row: score below it is flagged; sample size
    features: tuple[str, ...]


def path_constant(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    harmonic = np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma
    out = 2.0 * harmonic - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _digest(*parts: Column) -> Column:
    """md5 of the parts' texts: any engine draws the same rows."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _number(digits: Column, length: int) -> Column:
    """The leading hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 1, length), 16, 10).cast("bigint")


def entries(trees: int, share: float) -> list[int]:
    """Where a 52-bit number passes from k to k + 1 trees, if each takes the row with this probability."""
    logs = [math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1) + k * math.log(share) + (trees - k) * math.log1p(-share)
            for k in range(trees)]
    total, bounds = 0.0, []
    for x in logs:
        total += math.exp(x)
        bounds.append(int(total * (1 << 52)))
    return [b for b in bounds if b < 1 << 52]


def entered(ids: list[Column], trees: int, share: float, seed: int) -> Column:
    """The trees that a row may be drawn for: each with the same probability, independently.

    One hash gives their number by the inverted binomial distribution, and one for each
    of them says which, without repetition (Floyd's subset sampling). In a large table
    nearly every row enters none, and costs one hash.
    """
    if share >= 1:
        return F.sequence(F.lit(0), F.lit(trees - 1))
    bounds = entries(trees, share)

    def number(at):
        return F.when(at < bounds[0], 0).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= at)))

    def chosen(number):
        draws = F.transform(F.sequence(F.lit(trees + 1) - number, F.lit(trees)), lambda j: F.struct(
            j.cast("int").alias("last"), (F.pmod(_number(_digest(*ids, F.lit(seed), F.lit("enters"), j), 8), j) + 1).cast("int").alias("tree")))
        got = F.aggregate(draws, F.array().cast("array<int>"), lambda got, d: F.concat(
            got, F.array(F.when(F.array_contains(got, d["tree"]), d["last"]).otherwise(d["tree"]))))
        return F.when(number > 0, F.transform(got, lambda tree: tree - 1))

    return _once(_once(_number(_digest(*ids, F.lit(seed)), 13), number), chosen)


def _once(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often the former names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def draw(df: DataFrame, identity: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, order) rows: ``sample`` rows for every tree (all, if there are fewer), chosen by row hash.

    Every tree draws from the whole table; a row may be in several trees. A row enters a
    tree with a probability that gives ``SPARE * sample`` rows on average, and the first by
    hash are kept, on the map side first. If a tree has come out short the share is
    raised, so the result is exact.
    """
    ids = [F.col(c) for c in identity]
    total = df.count()
    share = SPARE * sample / max(total, 1)
    w = Window.partitionBy("tree").orderBy(_digest(*ids, F.lit(seed), F.col("tree")), *ids)
    while True:
        rows = df.select("*", F.explode(entered(ids, trees, share, seed)).alias("tree"))
        drawn = stage(rows.withColumn("_draw", F.row_number().over(w)).where(F.col("_draw") <= sample), "samples")
        if share >= 1 or drawn.count() == trees * min(sample, total):
            return drawn
        share *= 2


def _grow(seed: int, columns: list[str], limit: int):
    """Grow one tree from its sample: at most ``sample`` rows per group.

    A node's place is 1 at the root, 2n and 2n + 1 below place n; its feature and cut
    follow from the md5 of seed, tree and place, so the forest can be stated in SQL.
    """
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows.sort_values("_draw")[columns].to_numpy(dtype="float64")
        nodes, pending = [], [(x, 0, 1, -1, "")]
        while pending:
            part, depth, place, parent, side = pending.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][side] = number
            node = dict(tree=tree, node=number, feature=-1, threshold=0.0, left=-1, right=-1,
                        size=len(part), depth=depth)
            nodes.append(node)
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if depth >= limit or len(spread) == 0:
                continue
            digits = hashlib.md5(f"{seed}|{tree}|{place}".encode()).hexdigest()
            feature = int(spread[int(digits[:8], 16) % len(spread)])
            column = part[:, feature]
            cut = float(column.min() + (int(digits[8:16], 16) + 0.5) / 2 ** 32 * (column.max() - column.min()))
            goes_left = column <= cut
            if goes_left.all():
                continue
            node["feature"], node["threshold"] = feature, cut
            pending.append((part[~goes_left], depth + 1, 2 * place + 1, number, "right"))
            pending.append((part[goes_left], depth + 1, 2 * place, number, "left"))
        return pd.DataFrame(nodes)
    return grow


def grow_forest(scaled: DataFrame, columns: list[str], identity: list[str], trees: int = TREES,
                sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    limit = int(np.ceil(np.log2(max(sample, 2))))
    drawn = draw(scaled.select(*identity, *columns), identity, trees, sample, seed)
    # A fixed partition count: the samples are small in bytes but growing them is not.
    spread = drawn.select("tree", "_draw", *columns).repartition(max(1, trees // TREES_PER_TASK), "tree")
    return (spread.groupBy("tree")
            .applyInPandas(_grow(seed, columns, limit), NODE_SCHEMA))


def _packed(nodes: pd.DataFrame):
    """Node table as flat arrays with global child positions; leaves point to themselves."""
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    sizes = nodes.groupby("tree").size()
    first = sizes.cumsum() - sizes
    base = nodes["tree"].map(first).to_numpy()
    here = np.arange(len(nodes))
    leaf = nodes["feature"].to_numpy() < 0
    left = np.where(leaf, here, base + nodes["left"].to_numpy())
    right = np.where(leaf, here, base + nodes["right"].to_numpy())
    length = nodes["depth"].to_numpy() + path_constant(nodes["size"].to_numpy())
    return (first.to_numpy(), np.where(leaf, 0, nodes["feature"].to_numpy()),
            nodes["threshold"].to_numpy(), left, right, length, int(nodes["depth"].max()))


def _fetched(nodes: DataFrame) -> pd.DataFrame:
    """The node table, checked to be no larger than a forest of the stated sizes makes it."""
    if (n := nodes.count()) > MOST_NODES:
        raise ValueError(f"a forest of {n} nodes is too large to go along with the scoring code")
    return nodes.toPandas()


def _score_column(df: DataFrame, nodes: DataFrame, columns: list[str], sample: Column) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(_packed(_fetched(nodes)))

    @F.pandas_udf("double")
    def mean_path(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        roots, feature, threshold, left, right, length, depth = shared.value
        for part in parts:
            x = part.to_numpy(dtype="float64")
            total = np.zeros(len(x))
            for start in range(0, len(x), ROWS_AT_ONCE):  # all trees in one step, some rows at a time
                some = x[start:start + ROWS_AT_ONCE]
                at = np.broadcast_to(roots, (len(some), len(roots)))
                rows = np.arange(len(some))[:, None]
                for _ in range(depth):
                    at = np.where(some[rows, feature[at]] <= threshold[at], left[at], right[at])
                total[start:start + len(some)] = length[at].sum(1)
            yield pd.Series(total / len(roots))

    # c(n) of the sample size, in closed form as in path_constant.
    n = sample.cast("double")
    norm = 2 * (F.log(n - 1) + float(np.euler_gamma)) - 2 * (n - 1) / n
    scale = F.when(n > 2, norm).otherwise(F.lit(1.0))
    return -F.pow(F.lit(2.0), -mean_path(F.struct(*columns)) / scale)


def iforest_fit(df: DataFrame, spec: PanelSpec, features=ANOMALY_FEATURES, trees: int = TREES,
                sample: int = SAMPLE, contamination: float = CONTAMINATION,
                seed: int = SEED) -> IsolationModel:
    """Fit scaler, forest and the score cut-off of the training rows."""
    columns = [c for c in features if c in df.columns]
    scaler = stage(scale_fit(df, columns), "scaler")
    scaled = scale_apply(df.select(spec.key, spec.time, *columns), scaler, columns, _Z)
    inputs = [_Z + c for c in columns]
    nodes = stage(grow_forest(scaled, inputs, [spec.key, spec.time], trees, sample, seed), "forest")
    size = df.agg(F.least(F.count(F.lit(1)), F.lit(sample)).alias("n")).scalar()
    score = scaled.select(_score_column(scaled, nodes, inputs, size).alias("score"))
    bound = quantile_row(stage(score, "scores"), ["score"], {"cut": contamination})
    cutoff = stage(bound.select(F.col("score_cut").alias("cutoff"), size.alias("sample")), "cutoff")
    return IsolationModel(nodes, scaler, cutoff, tuple(columns))


def iforest_score(df: DataFrame, model: IsolationModel) -> DataFrame:
    """Add ``if_score`` in [-1, 0); lower is odder."""
    columns = list(model.features)
    scaled = scale_apply(df, model.scaler, columns, _Z)
    inputs = [_Z + c for c in columns]
    size = model.cutoff.select("sample").scalar()
    return (scaled.withColumn("if_score", _score_column(df, model.nodes, inputs, size))
            .drop(*inputs))


def detect_global(df: DataFrame, model: IsolationModel) -> DataFrame:
    """Score, flag and severity of every row of a frame."""
    scored = iforest_score(df, model)
    cut = model.cutoff.select("cutoff").scalar()
    score = F.col("if_score")
    flagged = scored.withColumn("is_anomaly", score < cut)
    return flagged.withColumns({
        "if_flag": F.when(F.col("is_anomaly"), -1).otherwise(1),
        "severity": score_severity(score)})
