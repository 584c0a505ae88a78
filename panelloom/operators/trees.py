"""Tree-ensemble forecasts, one model for a whole panel or one key: a forest, and boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelloom.functions.exprs import unit_hash
from panelloom.operators import chunks, forest
from panelloom.operators.derive import LAGS, lag_features, lag_names
from panelloom.operators.forecast import ensemble, historical_view, holt_fit, holt_forecast, trend_projection
from panelloom.operators.stats import error_metrics
from panelloom.operators.windows import enough_history, timeseries_folds
from panelloom.sources.storage import stage
from panelloom.spec import PanelSpec

SEED = 42
HISTORY = 5          # longest lag and widest rolling mean
MOST_ROWS = 20_000   # rows that a tree draws on average; bounds its task and the forest's nodes
MIN_ROWS = 10        # known values that a key must have


@dataclass(frozen=True)
class ForestModel:
    nodes: DataFrame         # the node table, see forest.NODES
    target: str
    inputs: tuple[str, ...]
    metrics: DataFrame       # n, mae, r2 over all training rows


def training_rows(df: DataFrame, spec: PanelSpec, target: str, extra: list[str], leaky: bool) -> DataFrame:
    """Lag features with the rows that miss a used column dropped."""
    used = [c for c in [spec.time, *extra] if c in df.columns]
    passive = [c for c in used if c != spec.time]
    frame = df.select(spec.key, spec.time, target, *passive)
    return lag_features(frame, spec, target, leaky, required=[target, *lag_names(target), *used])


def forest_fit(df: DataFrame, spec: PanelSpec, target: str = "co2", trees: int = 300,
               depth: int = 30, leaky: bool = False, seed: int = SEED, most_rows: int = MOST_ROWS) -> ForestModel:
    """Random forest on lags, period and passive columns, with its errors over all training rows.

    Every tree draws about `most_rows` rows (as many as there are, if fewer) from all of them.
    """
    whole = training_rows(df, spec, target, list(spec.passive), leaky)
    inputs = [*lag_names(target), spec.time, *[c for c in spec.passive if c in df.columns]]
    whole = stage(whole.withColumns({c: F.col(c).cast("double") for c in [target, *inputs] if c != spec.time}), "forest-rows")
    nodes = stage(forest.fit(whole, [spec.key, spec.time], target, inputs, trees, depth, most_rows, seed), "forest-nodes")
    shared = df.sparkSession.sparkContext.broadcast(forest.Packed(nodes))

    @F.pandas_udf("double")
    def predicted(x: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.predict(x.to_numpy(dtype="float64")))

    metrics = error_metrics(whole.select(target, predicted(F.struct(*inputs)).alias("predicted")), target, "predicted")
    return ForestModel(nodes, target, tuple(inputs), metrics)


def feature_importance(fitted: ForestModel) -> DataFrame:
    """(feature, importance), largest first: the share of the squared error that its cuts take away."""
    return forest.importance(fitted.nodes, list(fitted.inputs))


def forest_trees(fitted: ForestModel) -> DataFrame:
    """(tree, rows, nodes, depth, total): draws, nodes and depth of every tree, and the sum of its leaves' targets in units."""
    leaf = F.col("feature") < 0
    return fitted.nodes.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("rows"))).alias("rows"), F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"),
        F.sum(F.when(leaf, F.col("total") * F.col("node"))).alias("total"))


def _next_inputs(values: np.ndarray, known: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Lag features of the next period; `values` holds the last values, newest last, `known` of them a row."""
    rows = np.arange(len(values))
    last = values[:, -1]
    back = lambda k: np.where(known >= k, values[rows, -np.minimum(k, values.shape[1])], last)

    def mean(k):
        total = np.zeros(len(values))
        for i in range(min(k, values.shape[1]), 0, -1):  # oldest first
            total = np.where(known >= i, total + values[:, -i], total)
        return total / np.minimum(known, k)

    return np.stack([*(back(k) for k in LAGS), last - back(2), mean(3), mean(5), period], axis=1)


def forest_forecast(df: DataFrame, spec: PanelSpec, fitted: ForestModel, horizon: int = 10) -> DataFrame:
    """Recursive forecast: every key moves ahead `horizon` periods in one pass over the keys.

    A row holds the key's last five values, so its size does not depend on the
    length of the series. Passive columns stay at their last known value. The nodes go
    along with the code, after their number is checked.
    """
    target = fitted.target
    passive = [c for c in spec.passive if c in fitted.inputs]
    known = df.where(F.col(target).isNotNull())
    tail = (chunks.last_rows(known.select(spec.key, spec.time, target), spec, HISTORY)
            .groupBy(spec.key)
            .agg(F.max(spec.time).cast("int").alias("last_year"),
                 F.transform(F.array_sort(F.collect_list(F.struct(spec.time, target))),
                             lambda r: r[target].cast("double")).alias("values")))
    if passive:
        frozen = df.groupBy(spec.key).agg(*[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(spec.time))).cast("double").alias(c) for c in passive])
        tail = tail.join(frozen, spec.key).na.fill(0.0, subset=passive)
    shared = df.sparkSession.sparkContext.broadcast(forest.Packed(fitted.nodes))

    def ahead(batches):
        for rows in batches:
            known = rows["values"].map(len).to_numpy()
            values = np.array([[np.nan] * (HISTORY - len(v)) + list(v) for v in rows["values"]], dtype="float64").reshape(-1, HISTORY)
            still, year = rows[passive].to_numpy(dtype="float64"), rows["last_year"].to_numpy()
            path = []
            for step in range(1, horizon + 1):
                x = np.concatenate([_next_inputs(values, known, (year + step).astype("float64")), still], axis=1)
                path.append(shared.value.predict(x))
                values = np.concatenate([values[:, 1:], path[-1][:, None]], axis=1)
                known = np.minimum(known + 1, HISTORY)
            yield pd.DataFrame({spec.key: np.repeat(rows[spec.key].to_numpy(), horizon),
                                spec.time: (year[:, None] + np.arange(1, horizon + 1)).ravel().astype("int32"),
                                "predicted": np.stack(path, axis=1).ravel()})

    kind = dict(df.dtypes)[spec.key]
    return tail.mapInPandas(ahead, f"`{spec.key}` {kind}, `{spec.time}` int, predicted double")


def _folds(df: DataFrame, spec: PanelSpec, target: str, folds: int, leaky: bool) -> tuple[DataFrame, list[str]]:
    """Training rows with their fold and role, and the inputs."""
    inputs = [*lag_names(target), spec.time]
    rows = training_rows(df, spec, target, [], leaky).select(
        spec.key, spec.time, *[F.col(c).cast("double").alias(c) for c in [target, *inputs] if c != spec.time])
    return timeseries_folds(rows, spec, folds), inputs


def boosting_folds(df: DataFrame, spec: PanelSpec, target: str = "co2", folds: int = 3, leaky: bool = False) -> DataFrame:
    """(fold, train, test, mae): the folds' sizes, and the error before the first round, of the training mean."""
    split, _ = _folds(df, spec, target, folds, leaky)
    split = stage(split, "folds")
    train = split.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("train"), F.avg(target).alias("mean"))
    return split.where("role = 'test'").join(train, "fold").groupBy("fold").agg(
        F.max("train").alias("train"), F.count(F.lit(1)).alias("test"), F.avg(F.abs(F.col(target) - F.col("mean"))).alias("mae"))


def boosting_cv(df: DataFrame, spec: PanelSpec, target: str = "co2", rounds: int = 200,
                rate: float = 0.05, depth: int = 4, subsample: float = 0.8, folds: int = 3,
                leaky: bool = False, seed: int = SEED, most_rows: int = MOST_ROWS) -> DataFrame:
    """Mean and population deviation of the fold errors of boosted trees.

    The folds advance side by side, each in a task of its own, on about `most_rows` of its
    training rows, chosen by hash (all, if there are no more); errors cover all test rows.
    """
    split, inputs = _folds(df, spec, target, folds, leaky)
    split = stage(split, "folds")
    train = split.where("role = 'train'")
    cuts = forest.cut_points(train, inputs)
    totals = {r.fold: r.n for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a fold
    if not totals:
        return df.sparkSession.createDataFrame([(0, None, None)], "folds long, mae_mean double, mae_std double")
    share = F.create_map(*[F.lit(x) for fold, n in totals.items() for x in (fold, most_rows / n)])
    drawn = train.where(unit_hash(F.col(spec.key), F.col(spec.time), F.lit(seed)) < share[F.col("fold")])
    grown = drawn.select(F.col("fold").cast("int").alias("tree"), spec.key, target, *inputs).repartition(folds, "tree").groupBy("tree").applyInPandas(
        forest.boost([spec.key, spec.time], target, inputs, cuts, rounds, rate, depth, subsample, seed), forest.ROUNDS)
    grown = stage(grown, "boosting-nodes")  # at most folds x rounds x 2^(depth + 1) rows
    models = {fold: forest.Packed(grown.where(F.col("tree") == fold).withColumn("tree", F.col("round"))) for fold in totals}
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def predicted(fold: pd.Series, x: pd.DataFrame) -> pd.Series:
        values, out = x.to_numpy(dtype="float64"), np.full(len(x), np.nan)
        for k, model in shared.value.items():
            mine = (fold == k).to_numpy()
            out[mine] = model.predict(values[mine]) * len(model.roots)  # rounds add up
        return pd.Series(out)

    test = split.where("role = 'test'").select("fold", target, predicted("fold", F.struct(*inputs)).alias("predicted"))
    return error_metrics(test, target, "predicted", ["fold"]).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"))


def ensemble_members(df: DataFrame, spec: PanelSpec, target: str = "co2", horizon: int = 10,
                     trees: int = 300, depth: int = 30, leaky: bool = False,
                     min_rows: int = MIN_ROWS) -> dict[str, DataFrame]:
    """The three member forecasts of every key with enough known values."""
    known = df.where(F.col(target).isNotNull())
    rows = stage(enough_history(known, spec, min_rows), "ensemble-rows")
    fitted = forest_fit(rows, spec, target, trees, depth, leaky)
    return {"rf": forest_forecast(rows, spec, fitted, horizon),
            "gbm": trend_projection(rows, spec, target, horizon),
            "holt": holt_forecast(holt_fit(rows, spec, target), spec, horizon)}


def ensemble_forecast(df: DataFrame, spec: PanelSpec, target: str = "co2", horizon: int = 10,
                      trees: int = 300, depth: int = 30, leaky: bool = False) -> DataFrame:
    """(key, period, predicted, model, type): history, members and their equal-weight mean."""
    members = ensemble_members(df, spec, target, horizon, trees, depth, leaky)
    members = {name: stage(part, f"forecast-{name}") for name, part in members.items()}
    out = ensemble(members, spec).withColumn("model", F.lit("ensemble"))
    for name, part in members.items():
        out = out.unionByName(part.withColumn("model", F.lit(name)))
    known = enough_history(df.where(F.col(target).isNotNull()), spec, MIN_ROWS)
    past = historical_view(known, spec, target).withColumn("model", F.lit("historical"))
    return out.withColumn("type", F.lit("forecast")).unionByName(past)
