"""Closed-form forecasts for all keys at once: trend projection and Holt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelloom.operators import chunks
from panelloom.operators.chunks import CHUNK
from panelloom.operators.ordering import stack_tagged
from panelloom.operators.stats import annual_total
from panelloom.operators.windows import tail_stats
from panelloom.spec import PanelSpec

ALPHA, BETA = 0.3, 0.1


def _steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_step")


def trend_projection(df: DataFrame, spec: PanelSpec, target: str = "co2", horizon: int = 10) -> DataFrame:
    """Recent mean plus step times recent trend."""
    stats = tail_stats(df, spec, target)
    steps = stats.select(spec.key, "last_year", "recent_mean", "recent_trend", _steps(horizon))
    return steps.select(
        spec.key, (F.col("last_year") + F.col("_step")).alias(spec.time),
        (F.col("recent_mean") + F.col("recent_trend") * F.col("_step")).alias("predicted"))


def _holt_step(state: Column, value: Column, alpha: float, beta: float) -> Column:
    level = alpha * value + (1 - alpha) * (state["level"] + state["trend"])
    return F.struct(level.alias("level"),
                    (beta * (level - state["level"]) + (1 - beta) * state["trend"]).alias("trend"))


def _fold(values: Column, level: float, trend: float, alpha: float, beta: float) -> Column:
    start = F.struct(F.lit(level).alias("level"), F.lit(trend).alias("trend"))
    return F.aggregate(values, start, lambda s, v: _holt_step(s, v, alpha, beta))


def holt_fit(df: DataFrame, spec: PanelSpec, target: str = "co2", alpha: float = ALPHA,
             beta: float = BETA) -> DataFrame:
    """(key, last period, level, trend) of double exponential smoothing.

    The update is linear in (level, trend), so each chunk of a series is folded
    on its own: once from a zero state, and once per unit state with zero inputs.
    Applying the chunks' maps in order gives the state of the whole series, with
    no array longer than a chunk (and one map per chunk of the key).
    """
    known = df.where(F.col(target).isNotNull()).select(spec.key, spec.time, F.col(target).alias("_v"))
    first = (known.withColumn("_i", F.row_number().over(Window.partitionBy(spec.key).orderBy(spec.time)))
             .where(F.col("_i") <= 2).groupBy(spec.key)
             .agg(F.max(F.when(F.col("_i") == 1, F.col("_v"))).alias("_s0"),
                  F.max(F.when(F.col("_i") == 2, F.col("_v"))).alias("_s1"),
                  F.max(spec.time).alias("_t1"), F.max("_i").alias("_count"))
             .where(F.col("_count") == 2))

    base = chunks.with_chunk(known, spec)
    series = F.array_sort(F.collect_list(F.struct(spec.time, "_v")))
    cells = base.groupBy(spec.key, CHUNK).agg(
        series.alias("_series"), F.max(spec.time).alias("_last"))
    later = (cells.join(first, spec.key)
             .withColumn("_values", F.transform(
                 F.filter("_series", lambda r: r[spec.time] > F.col("_t1")), lambda r: r["_v"])))
    zeros = F.transform("_values", lambda v: F.lit(0.0))
    maps = later.select(
        spec.key, CHUNK, "_last", "_s0", "_s1",
        _fold(F.col("_values"), 0.0, 0.0, alpha, beta).alias("_c"),
        _fold(zeros, 1.0, 0.0, alpha, beta).alias("_e1"),
        _fold(zeros, 0.0, 1.0, alpha, beta).alias("_e2"))
    ordered = F.array_sort(F.collect_list(F.struct(CHUNK, "_c", "_e1", "_e2")))
    start = F.struct(F.col("_s0").alias("level"), (F.col("_s1") - F.col("_s0")).alias("trend"))

    def apply(state, m):
        move = lambda part: (m["_c"][part] + m["_e1"][part] * state["level"]
                             + m["_e2"][part] * state["trend"])
        return F.struct(move("level").alias("level"), move("trend").alias("trend"))

    return (maps.groupBy(spec.key)
            .agg(ordered.alias("_maps"), F.max("_last").alias("last_year"),
                 F.first("_s0").alias("_s0"), F.first("_s1").alias("_s1"))
            .withColumn("_state", F.aggregate("_maps", start, apply))
            .select(spec.key, F.col("last_year").cast("int").alias("last_year"),
                    F.col("_state.level").alias("level"), F.col("_state.trend").alias("trend")))


def holt_forecast(fitted: DataFrame, spec: PanelSpec, horizon: int = 10) -> DataFrame:
    steps = fitted.select(spec.key, "last_year", "level", "trend", _steps(horizon))
    return steps.select(spec.key, (F.col("last_year") + F.col("_step")).alias(spec.time),
                        (F.col("level") + F.col("_step") * F.col("trend")).alias("predicted"))


def ensemble(models: dict[str, DataFrame], spec: PanelSpec) -> DataFrame:
    """Mean of the models per (key, period); periods all of them cover."""
    both = stack_tagged(models, "model")
    return (both.groupBy(spec.key, spec.time)
            .agg(F.avg("predicted").alias("predicted"), F.count(F.lit(1)).alias("_models"))
            .where(F.col("_models") == len(models)).drop("_models"))


def historical_view(df: DataFrame, spec: PanelSpec, target: str = "co2") -> DataFrame:
    return (df.where(F.col(target).isNotNull())
            .select(spec.key, spec.time, F.col(target).alias("predicted"))
            .withColumn("type", F.lit("historical")))


def global_trend(df: DataFrame, spec: PanelSpec, target: str = "co2", horizon: int = 10) -> DataFrame:
    """(period, total, type): yearly totals followed by their Holt forecast."""
    # One row per period from here on.
    totals = annual_total(df, spec, target)
    world = totals.withColumn(spec.key, F.lit("all"))
    ahead = holt_forecast(holt_fit(world, spec, target), spec, horizon)
    return stack_tagged({"historical": totals.select(spec.time, target),
                         "forecast": ahead.select(spec.time, F.col("predicted").alias(target))})


def confidence_band(forecast: DataFrame, share: float = 0.10) -> DataFrame:
    p = F.col("predicted")
    return forecast.withColumns({"upper": p * (1 + share), "lower": p * (1 - share)})


def projected_change(history: DataFrame, forecast: DataFrame, spec: PanelSpec, target: str = "co2") -> DataFrame:
    """Percent from each key's last known value to its last forecast."""
    last = (history.where(F.col(target).isNotNull()).groupBy(spec.key)
            .agg(F.max_by(F.col(target), F.col(spec.time)).alias("last_value")))
    end = forecast.groupBy(spec.key).agg(F.max_by(F.col("predicted"), F.col(spec.time)).alias("last_forecast"))
    change = F.try_divide(F.col("last_forecast") - F.col("last_value"), F.col("last_value")) * 100
    return last.join(end, spec.key).withColumn("change_pct", change)


def forecast_table(forecast: DataFrame, digits: int = 3) -> DataFrame:
    return forecast.withColumn("predicted", F.round("predicted", digits))
