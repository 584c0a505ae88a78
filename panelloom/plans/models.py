"""Queries on anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.exprs import score_severity
from panelloom.operators import forecast, forest, isolation, ordering, sequences, trees, windows
from panelloom.plans import fixtures, views
from panelloom.plans.oracle import cols, dec, forest_blocks, regression_blocks, sequence_blocks, sql
from panelloom.plans.registry import KEY, KEYS, SPEC, SQL_KEYS, features, query, show
from panelloom.plans.scores import scored_table
from panelloom.plans.tables import _SEV, _SEVS, _with_severity
from panelloom.sources import models, storage
from panelloom.spec import ANOMALY_FEATURES

KT = ["country", "year"]


def isolation_model(rows):
    return isolation.iforest_fit(rows, SPEC)


# --- anomalies -----------------------------------------------------------

_FOREST = forest_blocks("feat", ANOMALY_FEATURES, isolation.TREES, isolation.SAMPLE, isolation.SEED)
_FLAGGED = f"""SELECT feat.*, if_score, if_score < cut AS is_anomaly, CASE WHEN if_score < cut THEN -1 ELSE 1 END AS if_flag,
   {_SEV} AS severity FROM feat JOIN fscore USING (country, year), fcut"""


@query("iforest_fit", sql("""SELECT CAST(tree AS INT) AS tree, count(*) AS nodes, CAST(max(depth) AS INT) AS depth,
   CAST(sum(n) FILTER (leaf) AS BIGINT) AS rows FROM fnodes GROUP BY tree""", "feat", **_FOREST))
def iforest_fit(spark, sf):
    model = isolation_model(features(spark, sf))
    return (model.nodes.groupBy("tree")
            .agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"),
                 F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("rows")))


@query("iforest_score", sql("SELECT country, year, round(if_score, 6) AS if_score FROM fscore", "feat", **_FOREST))
def iforest_score(spark, sf):
    rows = features(spark, sf)
    return isolation.iforest_score(rows, isolation_model(rows)).select(*KT, F.round("if_score", 6).alias("if_score"))


@query("iforest_flag", sql(f"SELECT country, year, is_anomaly FROM ({_FLAGGED})", "feat", **_FOREST))
def iforest_flag(spark, sf):
    """Flags of the training rows: those below the cut-off quantile of their scores."""
    rows = features(spark, sf)
    return isolation.detect_global(rows, isolation_model(rows)).select(*KT, "is_anomaly")


@query("detect_global", sql(f"""SELECT country, year, round(if_score, 6) AS if_score, if_flag, is_anomaly, severity
   FROM ({_FLAGGED}) WHERE year >= 1995""", "feat", **_FOREST))
def detect_global(spark, sf):
    rows = features(spark, sf)
    out = isolation.detect_global(rows.where("year >= 1995"), isolation_model(rows))
    return out.select(*KT, F.round("if_score", 6).alias("if_score"), "if_flag", "is_anomaly", "severity")


@query("model_roundtrip", sql("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM feat", "feat"))
def model_roundtrip(spark, sf):
    rows = features(spark, sf)
    model = isolation_model(rows)
    path = storage.scratch_path(spark, "model")
    models.save_model(model, path)
    before = isolation.detect_global(rows, model).select(*KT, "if_score", "is_anomaly")
    after = isolation.detect_global(rows, models.load_model(spark, path)).select(
        *KT, F.col("if_score").alias("again"), F.col("is_anomaly").alias("again_flag"))
    same = (F.col("if_score") == F.col("again")) & (F.col("is_anomaly") == F.col("again_flag"))
    return before.join(after, KT).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("different"))


@query("score_severity", sql(f"SELECT event_id, {_SEV} AS severity FROM anomaly_scores", "anomaly_scores"))
def severities(spark, sf):
    return fixtures.anomaly_scores(spark, sf).select("event_id", score_severity(F.col("if_score")).alias("severity"))


_ZSEV = ("CASE WHEN abs(zscore) > 3.0 THEN 'critical' WHEN abs(zscore) > 2.25 THEN 'high' "
         "WHEN abs(zscore) > 1.5 THEN 'medium' ELSE 'normal' END")


@query("detect_country", sql(
    f"SELECT {cols(KT, ['co2', 'zscore'], 6)}, coalesce(abs(zscore) > 1.5, false) AS zscore_anomaly, {_ZSEV} AS zscore_severity FROM zscores",
    "zscores"))
def detect_country(spark, sf):
    out = windows.detect_key_series(features(spark, sf), SPEC, threshold=1.5)
    return show(out, [*KT, "zscore_anomaly", "zscore_severity"], ["co2", "zscore"], 6)


@query("anomaly_summary", sql(
    f"SELECT event_id, country, year, round(co2, 7) AS co2, severity FROM ({_SEVS}) WHERE is_anomaly", "anomaly_scores"))
def anomaly_summary(spark, sf):
    return show(ordering.severity_sort(_with_severity(spark, sf), SPEC), ["event_id", *KT, "severity"], ["co2"])


@query("alert_view", sql(
    f"""SELECT country, year, printf('%.2f', {dec('co2', 2)}) AS co2, printf('%.3f', {dec('if_score', 3)}) AS score,
               upper(severity) AS severity FROM ({_SEVS}) WHERE is_anomaly
        ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'HIGH' THEN 1
                 WHEN 'medium' THEN 2 WHEN 'MEDIUM' THEN 2 ELSE 3 END, country, year LIMIT 15""", "anomaly_scores"))
def alert_view(spark, sf):
    return views.alert_lines(_with_severity(spark, sf), SPEC)


_SEQUENCES = sequence_blocks("feat", ANOMALY_FEATURES, sequences.LENGTH, sequences.LATENT, sequences.STEPS, sequences.SEED, sequences.FLAT)


@query("sequence_error", sql(
    f"""SELECT f.country, f.year, round(coalesce(e, 0), 5) AS lstm_error,
               coalesce(e > (SELECT quantile_cont(e, {sequences.PERCENTILE}) FROM serr), false) AS lstm_anomaly
        FROM feat f LEFT JOIN serr ON f.country = serr.country AND f.year = serr.year""", "feat", **_SEQUENCES))
def sequence_error(spark, sf):
    out = sequences.sequence_error(features(spark, sf), SPEC)
    return out.select(*KT, F.round("lstm_error", 5).alias("lstm_error"), "lstm_anomaly")


_ORDER = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query("view_anomaly", sql(
    f"""SELECT 'row' AS part, country, year, severity, CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS text,
          round(greatest(-if_score, 0.01E0), 6) AS value FROM shown WHERE country IN ({SQL_KEYS})
        UNION ALL SELECT 'alert', country, year, upper(severity), concat(printf('%.2f', {dec('coalesce(co2, 0)', 2)}), ' ',
          printf('%.3f', {dec('if_score', 3)})), NULL FROM (SELECT * FROM shown WHERE is_anomaly ORDER BY {_ORDER}, country, year LIMIT 15)
        UNION ALL SELECT 'count', NULL, NULL, s, NULL, CAST((SELECT count(*) FROM shown WHERE is_anomaly AND (severity = s OR s = 'total')) AS DOUBLE)
          FROM (SELECT unnest(['critical', 'high', 'medium', 'total']) AS s)""",
    "feat", **_FOREST, shown=f"SELECT * FROM ({_FLAGGED}) WHERE year BETWEEN 1990 AND 2007"))
def view_anomaly(spark, sf):
    """The rows of the keys shown, the first alerts, and the counts, tagged."""
    rows = features(spark, sf)
    flagged = storage.stage(views.anomaly(rows, SPEC, isolation_model(rows), 1990, 2007), "flagged")
    return views.anomaly_page(flagged, SPEC, KEYS)


@query("view_country_z", sql(
    f"""SELECT country, year, round(co2, 6) AS co2, round(zscore, 6) AS zscore,
               coalesce(abs(zscore) > 2.5, false) AS zscore_anomaly FROM zscores WHERE country = '{KEY}'""", "zscores"))
def view_country_z(spark, sf):
    return show(views.key_zscore(features(spark, sf), SPEC, KEY), [*KT, "zscore_anomaly"], ["co2", "zscore"], 6)


# --- closed-form forecasts -----------------------------------------------

@query("trend_projection", sql("SELECT country, year, round(predicted, 5) AS predicted FROM trend", "trend"))
def trend_projection(spark, sf):
    return show(forecast.trend_projection(features(spark, sf), SPEC), KT, ["predicted"], 5)


@query("holt_fit", sql("SELECT country, last_year, round(level, 5) AS level, round(trend, 5) AS trend FROM fitted", "fitted"))
def holt_fit(spark, sf):
    return show(forecast.holt_fit(features(spark, sf), SPEC), ["country", "last_year"], ["level", "trend"], 5)


@query("holt_forecast", sql("SELECT country, year, round(predicted, 5) AS predicted FROM ahead", "ahead"))
def holt_forecast(spark, sf):
    rows = features(spark, sf)
    return show(forecast.holt_forecast(forecast.holt_fit(rows, SPEC), SPEC), KT, ["predicted"], 5)


def _closed_form(rows):
    return {"gbm": forecast.trend_projection(rows, SPEC),
            "holt": forecast.holt_forecast(forecast.holt_fit(rows, SPEC), SPEC)}


_MEAN = "SELECT country, year, avg(predicted) AS predicted FROM (SELECT * FROM trend UNION ALL SELECT * FROM ahead) GROUP BY 1, 2"


@query("forecast_align", sql("SELECT country, year, round(predicted, 5) AS predicted FROM both_models", "trend", "ahead", both_models=_MEAN))
def forecast_align(spark, sf):
    return show(forecast.ensemble(_closed_form(features(spark, sf)), SPEC), KT, ["predicted"], 5)


@query("global_trend", sql(
    """SELECT year, round(co2, 6) AS co2, 'historical' AS type FROM yearly
       UNION ALL SELECT CAST((SELECT max(year) FROM yearly) + step AS INT), round(level + step * trend, 6), 'forecast'
       FROM steps, (SELECT * FROM gsmooth ORDER BY i DESC LIMIT 1)""", "yearly", "gsmooth", "steps"))
def global_trend(spark, sf):
    return show(forecast.global_trend(features(spark, sf), SPEC), ["year", "type"], ["co2"], 6)


@query("historical_view", sql("SELECT country, year, round(co2, 7) AS predicted, 'historical' AS type FROM feat WHERE co2 IS NOT NULL", "feat"))
def historical_view(spark, sf):
    return show(forecast.historical_view(features(spark, sf), SPEC), [*KT, "type"], ["predicted"])


@query("confidence_band", sql(
    "SELECT country, year, round(predicted, 5) AS predicted, round(predicted * 1.1, 5) AS upper, round(predicted * 0.9, 5) AS lower FROM ahead",
    "ahead"))
def confidence_band(spark, sf):
    rows = features(spark, sf)
    ahead = forecast.holt_forecast(forecast.holt_fit(rows, SPEC), SPEC)
    return show(forecast.confidence_band(ahead), KT, ["predicted", "upper", "lower"], 5)


@query("projected_change", sql(
    """SELECT t.country, round(t.last_value, 5) AS last_value, round(a.p, 5) AS last_forecast,
              round((a.p - t.last_value) / t.last_value * 100, 5) AS change_pct
       FROM tails t JOIN (SELECT country, max_by(predicted, year) AS p FROM ahead GROUP BY country) a ON a.country = t.country""",
    "tails", "ahead"))
def projected_change(spark, sf):
    rows = features(spark, sf)
    ahead = forecast.holt_forecast(forecast.holt_fit(rows, SPEC), SPEC)
    out = forecast.projected_change(rows, ahead, SPEC)
    return show(out, ["country"], ["last_value", "last_forecast", "change_pct"], 5)


@query("forecast_table", sql(f"SELECT country, year, {dec('predicted', 3)} AS predicted FROM ahead", "ahead"))
def forecast_table(spark, sf):
    rows = features(spark, sf)
    return forecast.forecast_table(forecast.holt_forecast(forecast.holt_fit(rows, SPEC), SPEC)).select(*KT, "predicted")


@query("history_plus_forecast", sql(
    """SELECT country, year, round(co2, 5) AS predicted, 'historical' AS type FROM feat WHERE co2 IS NOT NULL
       UNION ALL SELECT country, year, round(predicted, 5), 'forecast' FROM trend""", "feat", "trend"))
def history_plus_forecast(spark, sf):
    rows = features(spark, sf)
    past = forecast.historical_view(rows, SPEC).drop("type")
    both = ordering.stack_tagged({"historical": past, "forecast": forecast.trend_projection(rows, SPEC)})
    return show(both, [*KT, "type"], ["predicted"], 5)


# --- tree forecasts ------------------------------------------------------

_REGRESSION = regression_blocks("feat", "co2", SPEC.passive, 300, 30, trees.SEED, forest.BINS, forest.UNITS)
_GROWN = {n: t for n, t in _REGRESSION.items() if not n.startswith("rw") and n != "rpred"}


@query("forest_fit", sql("""SELECT count(*) AS n, round(avg(abs(t - p)), 5) AS mae,
   round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 5) AS r2 FROM rbin JOIN rpred USING (country, year)""", "feat", **_REGRESSION))
def forest_fit(spark, sf):
    fitted = trees.forest_fit(features(spark, sf), SPEC)
    return show(fitted.metrics, ["n"], ["mae", "r2"], 5)


_NEXT = regression_blocks("feat", "co2", SPEC.passive, 300, 30, trees.SEED, forest.BINS, forest.UNITS, "rnext")


@query("forest_next", sql("SELECT country, CAST(year AS INT) AS year, round(p, 5) AS predicted FROM rpred", "feat", **_NEXT))
def forest_next(spark, sf):
    """The first step of the forest's forecast, which SQL can state."""
    rows = features(spark, sf)
    return show(trees.forest_forecast(rows, SPEC, trees.forest_fit(rows, SPEC), 1), KT, ["predicted"], 5)


@query("forest_forecast")
def forest_forecast(spark, sf):
    rows = features(spark, sf)
    fitted = trees.forest_fit(rows, SPEC)
    return show(trees.forest_forecast(rows, SPEC, fitted), KT, ["predicted"], 5)


@query("forest_trees", sql("""SELECT CAST(tree AS INT) AS tree, CAST(sum(n) FILTER (f IS NULL) AS BIGINT) AS rows, count(*) AS nodes,
   CAST(max(depth) AS INT) AS depth, CAST(sum(total * node) FILTER (f IS NULL) AS BIGINT) AS total FROM rnodes GROUP BY tree""", "feat", **_GROWN))
def forest_trees(spark, sf):
    """Of every tree the rows it drew, its nodes and depth, and a sum of its leaves that tells their places apart."""
    return trees.forest_trees(trees.forest_fit(features(spark, sf), SPEC))


@query("feature_importance", sql("""SELECT feature, round(coalesce(share / sum(share) OVER (), 0), 6) AS importance
   FROM rnames LEFT JOIN (SELECT f, sum(gain / whole) AS share FROM (
     SELECT f, gain, sum(gain) OVER (PARTITION BY tree) AS whole FROM rnodes WHERE f IS NOT NULL) GROUP BY f) USING (f)""", "feat", **_GROWN))
def feature_importance(spark, sf):
    fitted = trees.forest_fit(features(spark, sf), SPEC)
    return show(trees.feature_importance(fitted), ["feature"], ["importance"], 6)


@query("boosting_cv")
def boosting_cv(spark, sf):
    return show(trees.boosting_cv(features(spark, sf), SPEC), ["folds"], ["mae_mean", "mae_std"], 5)


@query("boosting_folds", sql(
    """SELECT CAST(fold AS INT) AS fold, max(train) AS train, count(*) AS test, round(avg(abs(t - mean)), 5) AS mae FROM (
         SELECT *, avg(t) FILTER (place < start) OVER (PARTITION BY fold) AS mean, count(*) FILTER (place < start) OVER (PARTITION BY fold) AS train
         FROM (SELECT *, n - (3 - fold + 1) * block AS start FROM (
           SELECT t, row_number() OVER (PARTITION BY country ORDER BY year) - 1 AS place, count(*) OVER (PARTITION BY country) AS n,
                  count(*) OVER (PARTITION BY country) // 4 AS block FROM rrow), range(1, 4) a(fold)))
       WHERE place >= start AND place < start + block GROUP BY fold""", "feat",
    rrow=regression_blocks("feat", "co2", (), 1, 0, trees.SEED, forest.BINS, forest.UNITS)["rrow"]))
def boosting_folds(spark, sf):
    return show(trees.boosting_folds(features(spark, sf), SPEC), ["fold", "train", "test"], ["mae"], 5)


_MEMBERS = """SELECT country, year, round(predicted, 5) AS predicted, 'gbm' AS model, 'forecast' AS type FROM trend
   UNION ALL SELECT country, year, round(predicted, 5), 'holt', 'forecast' FROM ahead
   UNION ALL SELECT country, year, round(co2, 5), 'historical', 'historical' FROM feat WHERE co2 IS NOT NULL"""


@query("ensemble_members", sql(_MEMBERS, "trend", "ahead", "feat"))
def ensemble_members(spark, sf):
    """The members and the history of the bundle that SQL can state, exactly."""
    known = windows.enough_history(features(spark, sf).where("co2 is not null"), SPEC, trees.MIN_ROWS)
    ahead = {"gbm": forecast.trend_projection(known, SPEC, "co2", 10),
             "holt": forecast.holt_forecast(forecast.holt_fit(known, SPEC, "co2"), SPEC, 10)}
    out = forecast.historical_view(known, SPEC, "co2").withColumn("model", F.lit("historical"))
    for name, part in ahead.items():
        out = out.unionByName(part.withColumns({"model": F.lit(name), "type": F.lit("forecast")}))
    return show(out, [*KT, "model", "type"], ["predicted"], 5)


@query("forest_periods", sql(
    """SELECT a.country, a.year, true AS inside FROM ahead a""", "ahead"))
def forest_periods(spark, sf):
    """Every key and period has a forest forecast, inside the range of the values that the trees saw."""
    rows = features(spark, sf)
    ahead = trees.forest_forecast(rows, SPEC, trees.forest_fit(rows, SPEC))
    ends = rows.agg(F.min("co2").alias("low"), F.max("co2").alias("high"))
    return ahead.join(ends, F.lit(True)).select(*KT, F.col("predicted").between(F.col("low"), F.col("high")).alias("inside"))


@query("ensemble_forecast")
def ensemble_forecast(spark, sf):
    out = trees.ensemble_forecast(features(spark, sf), SPEC)
    return show(out, [*KT, "model", "type"], ["predicted"], 5)


@query("view_forecast")
def view_forecast(spark, sf):
    return views.forecast_view(features(spark, sf), SPEC, "total_ghg", 10, KEY)


@query("kpi_report")
def kpi_report(spark, sf):
    rows = features(spark, sf)
    flagged = storage.stage(isolation.detect_global(rows, isolation_model(rows)), "flagged")
    one = rows.where(F.col("country") == KEY)
    ahead = trees.ensemble_forecast(one, SPEC).where("model = 'ensemble'").drop("model", "type")
    return views.kpi_report(rows, scored_table(rows), flagged, forecast.projected_change(one, ahead, SPEC), SPEC)


_REPORT = f"""SELECT s.*, anomalies, round(anomaly_rate, 7) AS anomaly_rate, critical_alerts, round(moved, 5) AS projected_change_pct, kpis.*
   FROM (SELECT count(DISTINCT country) AS keys, count(*) AS rows, CAST(min(year) AS INT) AS first_year, CAST(max(year) AS INT) AS last_year FROM feat) s,
        (SELECT count(*) FILTER (is_anomaly) AS anomalies, avg(CASE WHEN is_anomaly THEN 1.0E0 ELSE 0 END) AS anomaly_rate,
                count(*) FILTER (is_anomaly AND severity = 'critical') AS critical_alerts FROM ({_FLAGGED})), kpis,
        (SELECT (max_by(predicted, a.year) - max(last_value)) / max(last_value) * 100 AS moved
         FROM tails t JOIN ahead a ON a.country = t.country WHERE t.country = '{KEY}')"""


@query("kpi_report_closed", sql(_REPORT, "feat", "kpis", "tails", "ahead", **_FOREST))
def kpi_report_closed(spark, sf):
    """The report with the closed-form forecast, so that SQL can state all of its columns."""
    rows = features(spark, sf)
    flagged = storage.stage(isolation.detect_global(rows, isolation_model(rows)), "flagged")
    one = rows.where(F.col("country") == KEY)
    ahead = forecast.holt_forecast(forecast.holt_fit(one, SPEC), SPEC)
    out = views.kpi_report(rows, scored_table(rows), flagged, forecast.projected_change(one, ahead, SPEC), SPEC)
    return out.withColumns({"anomaly_rate": F.round("anomaly_rate", 7), "projected_change_pct": F.round("projected_change_pct", 5)})
