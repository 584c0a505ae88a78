"""Reports composed from the operators; each returns one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.functions.exprs import finite, title_case
from panelloom.operators import filters, forecast, joins, ordering, quantiles, scoring, stats, trees, windows
from panelloom.operators.isolation import IsolationModel, detect_global
from panelloom.sources.storage import stage
from panelloom.spec import PanelSpec

SCORE = scoring.SCORE


def overview(features: DataFrame, spec: PanelSpec, bounds: DataFrame, key: str, metric: str,
             low: int | None = None, high: int | None = None) -> DataFrame:
    """One key's score, grade and latest metric next to the table-wide figures."""
    metric = filters.metric_column(features, metric)
    rows = filters.year_range(features, spec, low, high)
    scored = stage(scoring.score_panel(rows, spec, bounds, breakdown=False), "scored")
    versus = scoring.score_vs_average(scored, spec, key)
    kpi = quantiles.as_struct(stats.global_kpis(scored, spec))
    latest = rows.where(F.col(spec.key) == key).agg(F.max_by(F.col(metric), F.col(spec.time)).alias("v")).scalar()
    return versus.select(
        spec.key, "score", "grade", "label", F.lit(title_case(metric)).alias("metric"),
        F.coalesce(latest, F.lit(0.0)).alias("metric_value"), "global_avg_score", "difference", "band",
        kpi["countries_critical"].alias("countries_critical"),
        kpi["countries_excellent"].alias("countries_excellent"),
        kpi["top_country"].alias("top_country"), kpi["top_score"].alias("top_score"))


def trend(features: DataFrame, spec: PanelSpec, metric: str, keys, low: int | None = None,
          high: int | None = None) -> DataFrame:
    """(key, period, value) of a metric; one key for a single series."""
    metric = filters.metric_column(features, metric)
    rows = filters.key_in_list(filters.year_range(features, spec, low, high), spec, keys)
    return rows.select(spec.key, spec.time, F.col(metric).alias("value"))


def anomaly(features: DataFrame, spec: PanelSpec, model: IsolationModel, low: int | None = None,
            high: int | None = None) -> DataFrame:
    """Scored, flagged and labelled rows of the range; filter or count from here."""
    return filters.flag_label(detect_global(filters.year_range(features, spec, low, high), model))


def anomaly_page(flagged: DataFrame, spec: PanelSpec, keys) -> DataFrame:
    """(part, key, period, severity, text, value): rows of the keys, first alerts, counts by severity."""
    columns = ["part", spec.key, spec.time, "severity", "text", "value"]
    nothing = F.lit(None)
    rows = flagged.where(F.col(spec.key).isin(*keys)).select(
        F.lit("row").alias("part"), spec.key, spec.time, "severity", F.col("anomaly_label").alias("text"),
        F.round("size_val", 6).alias("value"))
    alerts = alert_lines(flagged, spec).select(
        F.lit("alert").alias("part"), spec.key, spec.time, "severity", F.concat_ws(" ", "co2", "score").alias("text"),
        nothing.cast("double").alias("value"))
    one = stats.alert_counts(flagged)
    counts = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("severity"), F.col(c).cast("double").alias("value")) for c in one.columns])))
    counts = counts.select(F.lit("count").alias("part"), nothing.cast("string").alias(spec.key), nothing.cast("int").alias(spec.time),
                           "severity", nothing.cast("string").alias("text"), "value")
    return rows.select(*columns).unionByName(alerts.select(*columns)).unionByName(counts.select(*columns))


def alert_lines(flagged: DataFrame, spec: PanelSpec, n: int = 15) -> DataFrame:
    """The first alerts, formatted for display."""
    rows = ordering.severity_head(flagged, spec, n)
    return rows.select(
        spec.key, spec.time, F.format_string("%.2f", F.coalesce("co2", F.lit(0.0))).alias("co2"),
        F.format_string("%.3f", "if_score").alias("score"), F.upper("severity").alias("severity"))


def key_zscore(panel: DataFrame, spec: PanelSpec, key: str, threshold: float = 2.5) -> DataFrame:
    """Rolling z-score of one key over its unfiltered series."""
    return windows.detect_key_series(panel.where(F.col(spec.key) == key), spec, threshold=threshold)


def forecast_view(features: DataFrame, spec: PanelSpec, metric: str, horizon: int, key: str | None = None,
                  tree_count: int = 300, depth: int = 30) -> DataFrame:
    """History, ensemble and member forecasts, and the trend of the total over all keys, rounded for display."""
    metric = filters.metric_column(features, metric)
    rows = features if key is None else features.where(F.col(spec.key) == key)
    total = forecast.global_trend(features, spec, metric, horizon).select(
        F.lit("all").alias(spec.key), spec.time, F.col(metric).alias("predicted"), F.lit("global").alias("model"), "type")
    found = trees.ensemble_forecast(rows, spec, metric, horizon, tree_count, depth)
    return forecast.forecast_table(found.unionByName(total))


def score_map(features: DataFrame, scored: DataFrame, spec: PanelSpec, metric: str = SCORE) -> DataFrame:
    """Latest score, code and metric of every key that has all three."""
    rows = joins.code_join(windows.latest_per_key(scored, spec, [SCORE]), features, spec)
    columns = [spec.key, spec.code, spec.time, SCORE]
    if metric != SCORE:
        metric = filters.metric_column(features, metric, SCORE)
    if metric != SCORE:
        rows = joins.latest_metric_join(rows, features, spec, metric)
        columns.append(metric)
    return filters.drop_any_null(rows.select(*columns), [spec.code, metric])


def map_view(features: DataFrame, scored: DataFrame, spec: PanelSpec, n: int = 10) -> DataFrame:
    """The n best and n worst keys of the map, tagged."""
    rows = joins.code_join(windows.latest_per_key(scored, spec, [SCORE]), features, spec)
    rows = rows.select(spec.key, spec.code, SCORE)
    order = [spec.key, spec.code]
    return ordering.stack_tagged({
        "best": ordering.top_k(rows, SCORE, n, order),
        "worst": ordering.top_k(rows, SCORE, n, order, largest=False)}, "side")


def leaderboard_view(features: DataFrame, spec: PanelSpec, bounds: DataFrame, bins: int = 30) -> DataFrame:
    """(part, position, key, grade, value): the board of the unfiltered table and the histogram of its scores."""
    scored = scoring.score_panel(features, spec, bounds, breakdown=False)
    board = stage(scoring.leaderboard(scored, spec), "board")
    rows = board.select(F.lit("board").alias("part"), F.col("rank").alias("position"), spec.key, "grade", F.col(SCORE).alias("value"))
    bars = scoring.score_histogram(board, bins).select(
        F.lit("histogram").alias("part"), F.col("bin").alias("position"), F.lit(None).cast("string").alias(spec.key),
        F.lit(None).cast("string").alias("grade"), F.col("n").cast("double").alias("value"))
    return rows.unionByName(bars)


def global_trend_view(panel: DataFrame, spec: PanelSpec, target: str = "co2", start: int = 1900) -> DataFrame:
    rows = filters.year_filter(filters.sovereign_filter(panel, spec), spec, start)
    return stats.annual_total(rows, spec, target)


def distributions(panel: DataFrame, spec: PanelSpec, columns: list[str], bins: int = 50,
                  high: float = 0.98) -> DataFrame:
    """(column, mean, median, bin, low, high, n) of values below the high quantile."""
    x = {c: finite(F.col(c).cast("double")) for c in columns}
    marks = quantiles.as_struct(quantiles.quantile_row(panel, columns, {"median": 0.5, "high": high}))
    below = panel.withColumn("_q", marks).select(*[F.when(x[c] < F.col(f"_q.{c}_high"), x[c]).alias(c) for c in columns])
    one = panel.agg(*[F.avg(x[c]).alias(c) for c in columns]).withColumn("_q", marks)
    named = one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).alias("mean"), F.col(f"_q.{c}_median").alias("median")) for c in columns])))
    return quantiles.histograms(below, columns, bins).join(F.broadcast(named), "column")  # one row a column


def fossil_top(features: DataFrame, spec: PanelSpec, n: int = 20) -> DataFrame:
    """Latest complete row of each key, highest fossil ratio first."""
    known = filters.drop_any_null(features, [spec.key, spec.time, "fossil_ratio"])
    latest = windows.latest_per_key(known, spec, ["fossil_ratio", "co2_per_capita"])
    rows = filters.drop_any_null(latest.select(spec.key, "fossil_ratio", "co2_per_capita"))
    return ordering.top_k(rows, "fossil_ratio", n, [spec.key])


def emitters_top(panel: DataFrame, spec: PanelSpec, n: int = 15) -> DataFrame:
    """Largest of the last period, by total and per head, tagged."""
    rows = filters.latest_year_filter(filters.sovereign_filter(panel, spec), spec)
    rows = rows.select(spec.key, "co2", "co2_per_capita", "population")
    return ordering.stack_tagged({
        "total": ordering.top_k(rows, "co2", n, [spec.key]),
        "per_capita": ordering.top_k(rows, "co2_per_capita", n, [spec.key])}, "by")


def kpi_report(features: DataFrame, scored: DataFrame, flagged: DataFrame, change: DataFrame,
               spec: PanelSpec) -> DataFrame:
    """One row: table size, alert rate, projected change and score figures."""
    size = stats.distinct_count(features, spec)
    rate = quantiles.as_struct(stats.anomaly_rate(flagged))
    alerts = quantiles.as_struct(stats.alert_counts(flagged))
    kpi = quantiles.as_struct(stats.global_kpis(scored, spec))
    moved = change.agg(F.avg("change_pct").alias("c")).scalar()
    return size.select(
        "*", rate["flagged"].alias("anomalies"), rate["rate"].alias("anomaly_rate"),
        alerts["critical"].alias("critical_alerts"), moved.alias("projected_change_pct"),
        *[kpi[c].alias(c) for c in ("global_avg_score", "global_median_score", "countries_excellent",
                                    "countries_critical", "top_country", "top_score",
                                    "bottom_country", "bottom_score")])
