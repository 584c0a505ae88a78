"""Queries over the panel: sources, filters, repair, features, windows, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.exprs import score_severity, zscore_severity
from panelloom.operators import chunks, derive, filters, joins, ordering, quantiles, repair, scoring, stats, windows
from panelloom.plans import fixtures, views
from panelloom.plans.oracle import DERIVED, FE, NUMBERS, START, W, cols, dec, rnd, sql
from panelloom.plans.registry import KEY, KEYS, SPEC, SQL_KEYS, features, panel, query, show
from panelloom.sources import images, storage, tabular
from panelloom.spec import ANOMALY_FEATURES, CORRELATION_COLUMNS, DISTRIBUTION_COLUMNS, SOURCE_COLUMNS, SUMMARY_COLUMNS, PanelSpec

ID = ["country", "iso_code", "year"]
KT = ["country", "year"]


# --- sources and sinks ---------------------------------------------------

@query("scan_csv", sql(f"SELECT {cols(ID + NUMBERS)} FROM panel", "panel"))
def scan_csv(spark, sf):
    path = storage.scratch_path(spark, "panel-csv")
    tabular.write_table(fixtures.from_sql(spark, sf, fixtures.PANEL_SQL), path, "csv")
    return show(tabular.scan_csv(spark, path, SPEC), ID + NUMBERS)


@query("export_csv", sql(
    f"""SELECT 'processed' AS output, count(*) AS n, {rnd('sum(co2)', 'co2', 6)} FROM feat
        UNION ALL SELECT 'latest_snapshot', count(*), round(sum(co2), 6) FROM
          (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1)
        UNION ALL SELECT 'key_countries', count(*), round(sum(co2), 6) FROM feat WHERE country IN ({SQL_KEYS})""", "feat"))
def export_csv(spark, sf):
    folder = storage.scratch_path(spark, "export")
    paths = tabular.export_panel(features(spark, sf), SPEC, folder, "csv", KEYS)
    read = {name: tabular.scan_csv(spark, path, SPEC) for name, path in paths.items()}
    both = ordering.stack_tagged({n: d.select("co2") for n, d in read.items()}, "output")
    return both.groupBy("output").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("co2"), 6).alias("co2"))


@query("normalise_headers", sql(f"SELECT {cols(ID, ['co2', 'gdp'])} FROM panel", "panel"))
def normalise_headers(spark, sf):
    rows = panel(spark, sf)
    messy = rows.toDF(*[f" {c.upper()} " for c in rows.columns])
    return show(tabular.normalise_headers(messy), ID, ["co2", "gdp"])


@query("frame_sample", sql(
    """SELECT video_id, frame_no, event_id FROM frames WHERE frame_no % 7 = 0
       QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_no) <= 5""", "frames"))
def frame_sample(spark, sf):
    return images.frame_sample(fixtures.frames(spark, sf), every=7, most=5)


# --- projections and filters ---------------------------------------------

@query("sovereign_filter", sql(f"SELECT {cols(ID, ['co2'])} FROM panel WHERE length(iso_code) = 3", "panel"))
def sovereign_filter(spark, sf):
    return show(filters.sovereign_filter(panel(spark, sf), SPEC), ID, ["co2"])


@query("year_filter", sql(f"SELECT {cols(ID, ['co2'])} FROM panel WHERE year >= {START}", "panel"))
def year_filter(spark, sf):
    return show(filters.year_filter(panel(spark, sf), SPEC, START), ID, ["co2"])


@query("year_range", sql(
    f"""SELECT {cols(ID, ['co2'])} FROM panel
        WHERE year BETWEEN (SELECT greatest(min(year), 1990) FROM panel) AND 2005""", "panel"))
def year_range(spark, sf):
    return show(filters.year_range(panel(spark, sf), SPEC, high=2005, floor=1990), ID, ["co2"])


@query("prune_columns", sql(f"SELECT {cols(ID + NUMBERS)} FROM panel", "panel"))
def prune_columns(spark, sf):
    rows = panel(spark, sf).withColumns({"extra": F.lit("x"), "unused": F.lit(1)})
    pruned = filters.prune_columns(rows, SPEC)
    return pruned


SPARSE = PanelSpec(features=("methane", "coal_co2", "gas_co2"))


@query("drop_all_null", sql(
    f"""SELECT {cols(ID, SPARSE.features)} FROM panel
        WHERE methane IS NOT NULL OR coal_co2 IS NOT NULL OR gas_co2 IS NOT NULL""", "panel"))
def drop_all_null(spark, sf):
    return show(filters.drop_all_null(panel(spark, sf), SPARSE), ID, SPARSE.features)


@query("drop_any_null", sql(
    f"""SELECT {cols(ID, ['co2', 'gdp', 'coal_co2'])} FROM panel
        WHERE co2 IS NOT NULL AND gdp IS NOT NULL AND coal_co2 IS NOT NULL""", "panel"))
def drop_any_null(spark, sf):
    return show(filters.drop_any_null(panel(spark, sf), ["co2", "gdp", "coal_co2"]), ID, ["co2", "gdp", "coal_co2"])


@query("key_filter", sql(f"SELECT {cols(ID, ['co2'])} FROM panel WHERE country = '{KEY}' ORDER BY year", "panel"))
def key_filter(spark, sf):
    return show(filters.key_filter(panel(spark, sf), SPEC, KEY), ID, ["co2"])


@query("key_in_list", sql(f"SELECT {cols(ID, ['co2'])} FROM panel WHERE country IN ({SQL_KEYS})", "panel"))
def key_in_list(spark, sf):
    return show(filters.key_in_list(panel(spark, sf), SPEC, KEYS), ID, ["co2"])


@query("flag_filter", sql("SELECT event_id, country, round(if_score, 7) AS if_score FROM anomaly_scores WHERE is_anomaly",
                          "anomaly_scores"))
def flag_filter(spark, sf):
    return show(fixtures.anomaly_scores(spark, sf).where("is_anomaly"), ["event_id", "country"], ["if_score"])


@query("coerce_numeric", """
SELECT event_id, TRY_CAST(props AS DOUBLE) AS props,
       TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value_text
FROM events""")
def coerce_numeric(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    rows = fixtures.table(spark, sf, "events").select("event_id", "props", text.alias("value_text"))
    return filters.coerce_numeric(rows, ["props", "value_text"])


@query("tag_rows", sql(f"SELECT {cols(KT, ['co2'])}, 'historical' AS type FROM panel", "panel"))
def tag_rows(spark, sf):
    return ordering.stack_tagged({"historical": show(panel(spark, sf), KT, ["co2"])})


@query("flag_label", sql(
    """SELECT event_id, CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS anomaly_label,
              round(greatest(-if_score, 0.01E0), 7) AS size_val FROM anomaly_scores""", "anomaly_scores"))
def flag_label(spark, sf):
    return show(filters.flag_label(fixtures.anomaly_scores(spark, sf)), ["event_id", "anomaly_label"], ["size_val"])


@query("key_domain", sql(
    "SELECT DISTINCT country, (SELECT min(year) FROM panel) AS first, (SELECT max(year) FROM panel) AS last FROM panel",
    "panel"))
def key_domain(spark, sf):
    rows = panel(spark, sf)
    ends = quantiles.as_struct(filters.time_domain(rows, SPEC))
    return filters.key_domain(rows, SPEC).select("country", ends["first"].alias("first"), ends["last"].alias("last"))


@query("latest_year_filter", sql(f"SELECT {cols(ID, ['co2'])} FROM panel WHERE year = (SELECT max(year) FROM panel)", "panel"))
def latest_year_filter(spark, sf):
    return show(filters.latest_year_filter(panel(spark, sf), SPEC), ID, ["co2"])


@query("enough_history", sql(
    f"""SELECT {cols(KT, ['co2'])} FROM panel WHERE co2 IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY country) >= 25""", "panel"))
def enough_history(spark, sf):
    known = panel(spark, sf).where("co2 IS NOT NULL")
    return show(windows.enough_history(known, SPEC, 25), KT, ["co2"])


@query("dynamic_metric", sql(
    """SELECT country, year, round(total_ghg, 7) AS total_ghg, round(co2, 7) AS fallback FROM panel""", "panel"))
def dynamic_metric(spark, sf):
    rows = panel(spark, sf)
    known = filters.metric_column(rows, "total_ghg", "co2")
    absent = filters.metric_column(rows, "sustainability_score", "co2")
    return rows.select(*KT, F.round(known, 7).alias("total_ghg"), F.round(absent, 7).alias("fallback"))


# --- null repair and features --------------------------------------------

_FF = ", ".join(f"last_value({c} IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING) AS {c}" for c in FE)
_BF = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING), "
                f"first_value({c} IGNORE NULLS) OVER {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
                for c in FE)


@query("ffill", sql(f"SELECT country, year, {_FF} FROM panel", "panel"))
def ffill(spark, sf):
    return show(repair.ffill(panel(spark, sf), SPEC), KT + FE)


@query("bfill", sql(f"SELECT country, year, {_BF} FROM panel", "panel"))
def bfill(spark, sf):
    return show(repair.bfill(panel(spark, sf), SPEC), KT + FE)


@query("fill_zero", sql(
    "SELECT country, year, gdp, " + ", ".join(f"coalesce({c}, 0.0E0) AS {c}" for c in FE) + " FROM panel", "panel"))
def fill_zero(spark, sf):
    return show(repair.fill_zero(panel(spark, sf), FE), [*KT, "gdp", *FE])


@query("inf_to_null", sql(
    "SELECT country, year, CASE WHEN year % 5 < 2 THEN NULL ELSE round(co2, 7) END AS co2 FROM panel", "panel"))
def inf_to_null(spark, sf):
    bad = (F.when(F.col("year") % 5 == 0, F.lit(float("inf"))).when(F.col("year") % 5 == 1, F.lit(float("-inf")))
           .otherwise(F.col("co2")))
    return show(repair.inf_to_null(panel(spark, sf).withColumn("co2", bad), ["co2"]), KT, ["co2"])


@query("clean", sql(f"SELECT {cols(ID + NUMBERS)} FROM kept", "kept"))
def clean(spark, sf):
    return show(repair.clean(panel(spark, sf), SPEC, START), ID + NUMBERS)


def _derived(name, build):
    @query(name, sql(f"SELECT {cols(KT, [build[0]])} FROM feat", "feat"))
    def run(spark, sf):
        cleaned = repair.clean(panel(spark, sf), SPEC, START)
        return show(build[1](cleaned), KT, [build[0]])


_derived("yoy_change", ("co2_yoy_change", lambda d: derive.yoy_change(d, SPEC)))
_derived("rolling_mean", ("co2_rolling5", lambda d: derive.rolling5(d, SPEC)))
_derived("fossil_ratio", ("fossil_ratio", derive.ratio_columns))
_derived("renewable_proxy", ("renewable_proxy", derive.ratio_columns))
_derived("co2_intensity", ("co2_intensity", derive.ratio_columns))


@query("features", sql(f"SELECT {cols(ID + NUMBERS, DERIVED)} FROM feat", "feat"))
def feature_table(spark, sf):
    cleaned = storage.stage(repair.clean(panel(spark, sf), SPEC, START), "clean")
    return show(derive.features(cleaned, SPEC), ID + NUMBERS, DERIVED)


@query("cached_views", sql("SELECT count(*) AS rows, true AS reused FROM feat", "feat"))
def cached_views(spark, sf):
    """The feature table is written once for a state of the tables: a second request reads the same files."""
    first, second = features(spark, sf), features(spark, sf)
    same = sorted(first.inputFiles()) == sorted(second.inputFiles())
    return second.agg(F.count(F.lit(1)).alias("rows")).withColumn("reused", F.lit(same))


@query("pipeline_run", sql(f"SELECT {cols(ID + NUMBERS, DERIVED)} FROM feat90", "feat90"))
def pipeline_run(spark, sf):
    return show(derive.pipeline(panel(spark, sf), SPEC), ID + NUMBERS, DERIVED)


_MM = ", ".join(rnd(f"({c} - min({c}) OVER ()) / coalesce(nullif(max({c}) OVER () - min({c}) OVER (), 0), 1)", c)
                for c in FE + DERIVED)


@query("minmax_normalise", sql(f"SELECT country, year, round(gdp, 7) AS gdp, {_MM} FROM feat", "feat"))
def minmax_normalise(spark, sf):
    return show(derive.minmax_normalise(features(spark, sf), SPEC), KT, ["gdp", *FE, *DERIVED])


_SC = ", ".join(rnd(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / "
                    f"coalesce(nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 1)", c) for c in ANOMALY_FEATURES)


@query("standard_scale", sql(f"SELECT country, year, {_SC} FROM feat", "feat"))
def standard_scale(spark, sf):
    return show(derive.standard_scale(features(spark, sf), list(ANOMALY_FEATURES)), KT, ANOMALY_FEATURES)


# --- windows -------------------------------------------------------------

_LAGS = derive.lag_names("co2")


@query("lag_features", sql(
    f"""SELECT {cols(KT, ['co2', 'gdp', *_LAGS])} FROM (
          SELECT country, year, co2, gdp, lag(co2, 1) OVER {W}) AS co2_lag1, lag(co2, 2) OVER {W}) AS co2_lag2,
                 lag(co2, 3) OVER {W}) AS co2_lag3, lag(co2, 5) OVER {W}) AS co2_lag5,
                 co2 - lag(co2) OVER {W}) AS co2_diff1, avg(co2) OVER {W} ROWS 2 PRECEDING) AS co2_rolling3,
                 avg(co2) OVER {W} ROWS 4 PRECEDING) AS co2_rolling5 FROM panel)
        WHERE co2 + gdp + co2_lag1 + co2_lag2 + co2_lag3 + co2_lag5 + co2_diff1 + co2_rolling3 + co2_rolling5 IS NOT NULL""",
    "panel"))
def lag_features(spark, sf):
    rows = panel(spark, sf).select(*KT, "co2", "gdp")
    return show(derive.lag_features(rows, SPEC), KT, ["co2", "gdp", *_LAGS])


@query("rolling_zscore", sql(
    f"SELECT {cols(KT, ['co2', 'zscore'], 6)}, coalesce(abs(zscore) > 1.5, false) AS zscore_anomaly FROM zscores", "zscores"))
def rolling_zscore(spark, sf):
    out = windows.rolling_zscore(features(spark, sf), SPEC, threshold=1.5)
    return show(out, [*KT, "zscore_anomaly"], ["co2", "zscore"], 6)


@query("zscore_severity", sql(
    """SELECT country, year, CASE WHEN abs(zscore) > 1.5 THEN 'critical' WHEN abs(zscore) > 1.125 THEN 'high'
              WHEN abs(zscore) > 0.75 THEN 'medium' ELSE 'normal' END AS zscore_severity FROM zscores""", "zscores"))
def zscore_severities(spark, sf):
    out = windows.rolling_zscore(features(spark, sf), SPEC)
    return out.select(*KT, zscore_severity(F.col("zscore"), 0.75).alias("zscore_severity"))


@query("latest_per_key", sql(
    f"SELECT {cols(ID + NUMBERS)} FROM panel QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1", "panel"))
def latest_per_key(spark, sf):
    return show(windows.latest_per_key(panel(spark, sf), SPEC), ID + NUMBERS)


@query("score_diff", sql(
    f"SELECT country, year, round(coalesce(base - lag(base) OVER {W}), 0), 4) AS score_yoy_change FROM based", "based"))
def score_diff(spark, sf):
    rows = features(spark, sf)
    based = scoring.base_score(rows, scoring.indicator_fit(rows), breakdown=False)
    return show(windows.score_diff(based, SPEC), KT, ["score_yoy_change"], 4)


@query("position_rank", sql(
    "SELECT row_number() OVER (ORDER BY co2 DESC NULLS LAST, country, year) AS rank, country, year FROM panel", "panel"))
def position_rank(spark, sf):
    rows = panel(spark, sf).select(*KT, "co2")
    placed = ordering.ranked(rows, [F.col("co2").desc_nulls_last(), F.col("country"), F.col("year")])
    return placed.select("rank", *KT)


@query("sequence_windows", sql(
    f"""SELECT country, year, round(lag(co2, 4) OVER {W}), 7) AS oldest, round(co2, 7) AS newest,
               round(lag(fossil_ratio, 2) OVER {W}), 7) AS middle, 5 AS steps
        FROM feat QUALIFY row_number() OVER {W}) >= 5""", "feat"))
def sequence_windows(spark, sf):
    runs = windows.sequence_windows(features(spark, sf), SPEC, ["co2", "fossil_ratio"])
    s = F.col("sequence")
    return runs.select(*KT, F.round(s[0][0], 7).alias("oldest"), F.round(s[4][0], 7).alias("newest"),
                       F.round(s[2][1], 7).alias("middle"), F.size(s).alias("steps"))


@query("tail_stats", sql(
    f"SELECT {cols(['country', 'last_year'], ['last_value', 'recent_mean', 'recent_trend'], 6)} FROM tails", "tails"))
def tail_stats(spark, sf):
    out = windows.tail_stats(features(spark, sf), SPEC)
    return show(out, ["country", "last_year"], ["last_value", "recent_mean", "recent_trend"], 6)


@query("timeseries_folds", sql(
    f"""SELECT country, year, fold, CASE WHEN pos < n - (4 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS role
        FROM (SELECT country, year, row_number() OVER {W}) - 1 AS pos, count(*) OVER (PARTITION BY country) AS n FROM feat),
             (SELECT unnest([1, 2, 3]) AS fold)
        WHERE pos < n - (3 - fold) * (n // 4)""", "feat"))
def timeseries_folds(spark, sf):
    return windows.timeseries_folds(features(spark, sf).select(*KT), SPEC).select(*KT, "fold", "role")


# --- aggregates and statistics -------------------------------------------

@query("annual_total", sql("SELECT year, round(coalesce(sum(co2), 0), 6) AS co2 FROM panel GROUP BY year", "panel"))
def annual_total(spark, sf):
    return show(stats.annual_total(panel(spark, sf), SPEC), ["year"], ["co2"], 6)


_SEV = ("CASE WHEN if_score < -0.35 THEN 'critical' WHEN if_score < -0.20 THEN 'high' "
        "WHEN if_score < -0.10 THEN 'medium' ELSE 'normal' END")
_SEVS = f"SELECT *, {_SEV} AS severity FROM anomaly_scores"


def _with_severity(spark, sf):
    return fixtures.anomaly_scores(spark, sf).withColumn("severity", score_severity(F.col("if_score")))


@query("value_counts", sql(
    f"""SELECT severity, count(*) AS n, round(count(*) / (SELECT count(*) FROM anomaly_scores)::DOUBLE, 7) AS share
        FROM ({_SEVS}) GROUP BY severity""", "anomaly_scores"))
def value_counts(spark, sf):
    return show(stats.value_counts(_with_severity(spark, sf), "severity"), ["severity", "n"], ["share"])


@query("alert_counts", sql(
    f"""SELECT count(*) FILTER (is_anomaly AND severity = 'critical') AS critical,
               count(*) FILTER (is_anomaly AND severity = 'high') AS high,
               count(*) FILTER (is_anomaly AND severity = 'medium') AS medium,
               count(*) FILTER (is_anomaly) AS total FROM ({_SEVS})""", "anomaly_scores"))
def alert_counts(spark, sf):
    return stats.alert_counts(_with_severity(spark, sf))


_DESC = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {dec(f'avg({c})', 3)} AS mean, {dec(f'stddev_samp({c})', 3)} AS std, "
    f"{dec(f'min({c})', 3)} AS min, {dec(f'quantile_cont({c}, 0.25)', 3)} AS q25, {dec(f'quantile_cont({c}, 0.5)', 3)} AS q50, "
    f"{dec(f'quantile_cont({c}, 0.75)', 3)} AS q75, {dec(f'max({c})', 3)} AS max FROM panel" for c in SUMMARY_COLUMNS)


@query("describe", sql(_DESC, "panel"))
def describe(spark, sf):
    return stats.describe(panel(spark, sf), list(SUMMARY_COLUMNS))


@query("missing_share", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 7) AS share FROM panel"
    for c in SUMMARY_COLUMNS), "panel"))
def missing_share(spark, sf):
    return show(stats.missing_share(panel(spark, sf), list(SUMMARY_COLUMNS)), ["column"], ["share"])


@query("corr_matrix", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS corr FROM panel"
    for a in CORRELATION_COLUMNS for b in CORRELATION_COLUMNS), "panel"))
def corr_matrix(spark, sf):
    return show(stats.corr_matrix(panel(spark, sf), list(CORRELATION_COLUMNS)), ["a", "b"], ["corr"])


@query("distinct_count", sql(
    "SELECT count(DISTINCT country) AS keys, count(*) AS rows, min(year) AS first_year, max(year) AS last_year FROM panel", "panel"))
def distinct_count(spark, sf):
    return stats.distinct_count(panel(spark, sf), SPEC)


@query("quantile_bounds", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.01), 7) AS low, round(quantile_cont({c}, 0.99), 7) AS high FROM panel"
    for c in FE), "panel"))
def quantile_bounds(spark, sf):
    table = quantiles.quantiles(panel(spark, sf), FE, [0.01, 0.99])
    return table.groupBy("column").agg(
        F.round(F.max(F.when(F.col("prob") == 0.01, F.col("value"))), 7).alias("low"),
        F.round(F.max(F.when(F.col("prob") == 0.99, F.col("value"))), 7).alias("high"))


@query("mean_median", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM panel"
    for c in DISTRIBUTION_COLUMNS), "panel"))
def mean_median(spark, sf):
    return show(stats.mean_median(panel(spark, sf), list(DISTRIBUTION_COLUMNS)), ["column"], ["mean", "median"], 6)


def histogram_sql(source: str, column: str, bins: int, where: str = "true") -> str:
    return (f"SELECT least(coalesce(CAST(floor(({column} - lo) / nullif((hi - lo) / {bins}, 0)) AS BIGINT), 0), {bins - 1}) AS bin, "
            f"count(*) AS n FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source} WHERE {where}) "
            f"WHERE {column} IS NOT NULL AND {where} GROUP BY 1")


@query("histogram", sql(histogram_sql("panel", "co2", 50), "panel"))
def histogram(spark, sf):
    return quantiles.histogram(panel(spark, sf), "co2", 50).select("bin", "n")


@query("quantile_trim", sql(
    f"""SELECT {cols(KT, ['co2'])}, co2 < (SELECT quantile_cont(co2, 0.98) FROM panel) AS below98 FROM panel
        WHERE co2 BETWEEN (SELECT quantile_cont(co2, 0.01) FROM panel) AND (SELECT quantile_cont(co2, 0.99) FROM panel)""", "panel"))
def quantile_trim(spark, sf):
    rows = panel(spark, sf)
    below = quantiles.trim(rows, "co2", None, 0.98, closed=False).select(*KT, F.lit(True).alias("below98"))
    inside = quantiles.trim(rows, "co2", 0.01, 0.99).join(below, KT, "left")
    return show(inside.withColumn("below98", F.coalesce("below98", F.lit(False))), [*KT, "below98"], ["co2"])


@query("error_metrics", sql(
    f"""SELECT country, count(*) AS n, round(avg(abs(co2 - m)), 9) AS mae,
               round(1 - sum((co2 - m) * (co2 - m)) / nullif(var_pop(co2) * count(*), 0), 6) AS r2
        FROM (SELECT country, co2, lag(co2) OVER {W}) AS m FROM feat) WHERE co2 IS NOT NULL AND m IS NOT NULL GROUP BY country""",
    "feat"))
def error_metrics(spark, sf):
    rows = chunks.over_history(features(spark, sf), SPEC, 1, {"before": lambda w: F.lag("co2").over(w)})
    out = stats.error_metrics(rows, "co2", "before", ["country"])
    return out.select("country", "n", F.round("mae", 9).alias("mae"), F.round("r2", 6).alias("r2"))


@query("percentile_threshold", sql(
    """SELECT round(quantile_cont(if_score, 0.05), 7) AS score_cut, round(quantile_cont(co2, 0.95), 7) AS value_cut
       FROM anomaly_scores""", "anomaly_scores"))
def percentile_threshold(spark, sf):
    rows = fixtures.anomaly_scores(spark, sf)
    table = quantiles.quantiles(rows, ["if_score", "co2"], [0.05, 0.95])
    pick = lambda c, p: F.round(F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value"))), 7)
    return table.agg(pick("if_score", 0.05).alias("score_cut"), pick("co2", 0.95).alias("value_cut"))


@query("anomaly_rate", sql(
    """SELECT count(*) FILTER (is_anomaly) AS flagged, count(*) AS rows, round(avg(CAST(is_anomaly AS INT)), 7) AS rate
       FROM anomaly_scores""", "anomaly_scores"))
def anomaly_rate(spark, sf):
    return show(stats.anomaly_rate(fixtures.anomaly_scores(spark, sf)), ["flagged", "rows"], ["rate"])


@query("source_breakdown", sql(" UNION ALL ".join(
    f"SELECT country, '{c}' AS source, round({c}, 7) AS amount FROM panel WHERE year = (SELECT max(year) FROM panel) "
    "AND coal_co2 + oil_co2 + gas_co2 + land_use_change_co2 IS NOT NULL" for c in SOURCE_COLUMNS), "panel"))
def source_breakdown(spark, sf):
    return show(stats.source_breakdown(panel(spark, sf), SPEC), ["country", "source"], ["amount"])


# --- sort, top-k, union --------------------------------------------------

@query("sort_key_time", sql(f"SELECT {cols(ID, ['co2'])} FROM panel ORDER BY country, year", "panel"))
def sort_key_time(spark, sf):
    return show(ordering.sort_key_time(panel(spark, sf), SPEC), ID, ["co2"])


@query("topk_largest", sql(
    f"SELECT {cols(KT, ['co2'])} FROM panel WHERE co2 IS NOT NULL ORDER BY co2 DESC, country, year LIMIT 15", "panel"))
def topk_largest(spark, sf):
    return show(ordering.top_k(panel(spark, sf), "co2", 15, KT), KT, ["co2"])


@query("topk_smallest", sql(
    f"SELECT {cols(KT, ['co2'])} FROM panel WHERE co2 IS NOT NULL ORDER BY co2, country, year LIMIT 10", "panel"))
def topk_smallest(spark, sf):
    return show(ordering.top_k(panel(spark, sf), "co2", 10, KT, largest=False), KT, ["co2"])


_SORTED = f"""
SELECT country, year, severity, round(if_score, 7) AS if_score FROM ({_SEVS}) WHERE is_anomaly
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, country, year"""


@query("severity_sort", sql(_SORTED, "anomaly_scores"))
def severity_sort(spark, sf):
    out = ordering.severity_sort(_with_severity(spark, sf), SPEC)
    return show(out, [*KT, "severity"], ["if_score"])


@query("head_tail", sql(
    f"""SELECT 'head' AS part, {cols(KT, ['co2'])} FROM (SELECT * FROM panel ORDER BY country, year LIMIT 20)
        UNION ALL SELECT 'tail', {cols(KT, ['co2'])} FROM (SELECT * FROM panel ORDER BY country DESC, year DESC LIMIT 10)""", "panel"))
def head_tail(spark, sf):
    rows = panel(spark, sf)
    both = ordering.stack_tagged({
        "head": ordering.head(rows, [F.col("country"), F.col("year")], 20),
        "tail": ordering.tail(rows, [("country", True), ("year", True)], 10)}, "part")
    return show(both, ["part", *KT], ["co2"])


@query("fossil_top", sql(
    """SELECT country, round(fossil_ratio, 7) AS fossil_ratio, co2_per_capita
       FROM (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1)
       ORDER BY fossil_ratio DESC, country LIMIT 20""", "feat"))
def fossil_top(spark, sf):
    return show(views.fossil_top(features(spark, sf), SPEC), ["country", "co2_per_capita"], ["fossil_ratio"])


_LAST = "(SELECT * FROM panel WHERE length(iso_code) = 3 AND year = (SELECT max(year) FROM panel WHERE length(iso_code) = 3))"


@query("emitters_top", sql(
    f"""SELECT 'total' AS by, {cols(['country', 'co2', 'co2_per_capita', 'population'])}
        FROM (SELECT * FROM {_LAST} WHERE co2 IS NOT NULL ORDER BY co2 DESC, country LIMIT 15)
        UNION ALL SELECT 'per_capita', {cols(['country', 'co2', 'co2_per_capita', 'population'])}
        FROM (SELECT * FROM {_LAST} WHERE co2_per_capita IS NOT NULL ORDER BY co2_per_capita DESC, country LIMIT 15)""", "panel"))
def emitters_top(spark, sf):
    return show(views.emitters_top(panel(spark, sf), SPEC), ["by", "country", "co2", "co2_per_capita", "population"])


# --- joins that need no scores -------------------------------------------

@query("iso_dedupe", sql("SELECT DISTINCT country, iso_code FROM panel", "panel"))
def iso_dedupe(spark, sf):
    return joins.code_lookup(panel(spark, sf), SPEC)


@query("fit_apply_join", sql(
    """SELECT country, year, round((co2 - lo) / (hi - lo), 7) AS co2 FROM panel,
              (SELECT min(co2) AS lo, max(co2) AS hi FROM panel WHERE year < 2000)""", "panel"))
def fit_apply_join(spark, sf):
    rows = panel(spark, sf)
    fitted = derive.minmax_fit(rows.where("year < 2000"), ["co2"])
    return show(derive.minmax_apply(rows, fitted, ["co2"]), KT, ["co2"])


# --- views over the panel ------------------------------------------------

@query("view_global_trend", sql(
    "SELECT year, round(coalesce(sum(co2), 0), 6) AS co2 FROM panel WHERE length(iso_code) = 3 AND year >= 1900 GROUP BY year", "panel"))
def view_global_trend(spark, sf):
    return show(views.global_trend_view(panel(spark, sf), SPEC), ["year"], ["co2"], 6)


_DIST = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", h.bin, h.n, round((SELECT avg({c}) FROM panel), 6) AS mean, "
    f"round((SELECT median({c}) FROM panel), 6) AS median FROM ("
    + histogram_sql("panel", c, 50, f"{c} < (SELECT quantile_cont({c}, 0.98) FROM panel)") + ") h" for c in DISTRIBUTION_COLUMNS)


@query("view_distributions", sql(_DIST, "panel"))
def view_distributions(spark, sf):
    out = views.distributions(panel(spark, sf), SPEC, list(DISTRIBUTION_COLUMNS))
    return show(out, ["column", "bin", "n"], ["mean", "median"], 6)
