"""Queries on composite scores and the reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.exprs import grade, label
from panelloom.operators import joins, scoring, stats, windows
from panelloom.plans import views
from panelloom.plans.oracle import CTES, PILLAR_COLUMNS, SCORED, cols, dec, grade_case, rnd, sql
from panelloom.plans.registry import KEY, KEYS, SPEC, SQL_KEYS, features, panel, query, show
from panelloom.plans.tables import histogram_sql
from panelloom.sources.storage import stage
from panelloom.spec import GRADES, INDICATORS, PILLARS

KT = ["country", "year"]
SCORE = scoring.SCORE
BREAK = {f"score_{i.name}": f"score_{i.column}" for i in INDICATORS}


def scored_table(rows, breakdown=False):
    """Scores of a feature table, written once for the reports on it."""
    return stage(scoring.score_panel(rows, SPEC, breakdown=breakdown), "scored")


@query("indicator_fit", sql(f"SELECT {', '.join(rnd(f'{i.column}_{e}') for i in SCORED for e in ('low', 'high'))} FROM bounds", "bounds"))
def indicator_fit(spark, sf):
    fitted = scoring.indicator_fit(features(spark, sf))
    return show(fitted, [], fitted.columns)


@query("indicator_norm", sql(f"SELECT {cols(KT, [f'norm_{i.column}' for i in SCORED])} FROM normed", "normed"))
def indicator_norm(spark, sf):
    rows = features(spark, sf)
    return show(scoring.indicator_norm(rows, scoring.indicator_fit(rows)), KT, [f"norm_{i.column}" for i in SCORED])


@query("base_score", sql(
    f"SELECT country, year, base AS {SCORE}, {', '.join(f'score_{i.column}' for i in SCORED)} FROM based", "based"))
def base_score(spark, sf):
    rows = features(spark, sf)
    out = scoring.base_score(rows, scoring.indicator_fit(rows)).withColumnsRenamed(BREAK)
    return out.select(*KT, SCORE, *[f"score_{i.column}" for i in SCORED])


@query("trend_bonus", sql(f"SELECT country, year, {SCORE}, score_yoy_change FROM scored", "scored"))
def trend_bonus(spark, sf):
    return scoring.score_panel(features(spark, sf), SPEC, breakdown=False)


@query("grade", sql(f"SELECT country, year, {grade_case(SCORE, 1)} AS grade FROM scored", "scored"))
def grades(spark, sf):
    out = scoring.score_panel(features(spark, sf), SPEC, breakdown=False)
    return out.select(*KT, grade(F.col(SCORE)).alias("grade"))


@query("label", sql(f"SELECT country, year, {grade_case(SCORE, 2)} AS label FROM scored", "scored"))
def labels(spark, sf):
    out = scoring.score_panel(features(spark, sf), SPEC, breakdown=False)
    return out.select(*KT, label(F.col(SCORE)).alias("label"))


@query("leaderboard", sql("SELECT * FROM board", "board"))
def leaderboard(spark, sf):
    return scoring.leaderboard(scoring.score_panel(features(spark, sf), SPEC, breakdown=False), SPEC)


@query("pillar_fit", sql(f"SELECT {', '.join(rnd(f'{c}_{e}') for c in PILLAR_COLUMNS for e in ('low', 'high'))} FROM pbounds", "pbounds"))
def pillar_fit(spark, sf):
    fitted = scoring.pillar_fit(features(spark, sf))
    return show(fitted, [], fitted.columns)


@query("pillar_score", sql(
    "SELECT country, year, round(" + " + ".join(f"p{i} * {p.weight}" for i, p in enumerate(PILLARS)) + ", 2) AS composite_score, "
    + ", ".join(f'round(p{i}, 2) AS "pillar_{p.name}"' for i, p in enumerate(PILLARS)) + " FROM pillars", "pillars"))
def pillar_score(spark, sf):
    rows = features(spark, sf)
    return scoring.pillar_score(rows, SPEC, scoring.pillar_fit(rows))


@query("global_kpis", sql("SELECT * FROM kpis", "kpis"))
def global_kpis(spark, sf):
    return stats.global_kpis(scored_table(features(spark, sf)), SPEC)


_BAND = (f"CASE WHEN {SCORE} >= 80 THEN '80-100' WHEN {SCORE} >= 65 THEN '65-80' WHEN {SCORE} >= 50 THEN '50-65' "
         f"WHEN {SCORE} >= 35 THEN '35-50' ELSE '0-35' END")


@query("score_vs_average", sql(
    f"""SELECT country, {SCORE} AS score, global_avg_score, {dec(f'{SCORE} - global_avg_score', 2)} AS difference,
               {grade_case(SCORE, 1)} AS grade, {grade_case(SCORE, 2)} AS label, {_BAND} AS band
        FROM latest, kpis WHERE country = '{KEY}'
        UNION ALL SELECT 'nobody', 50.0, global_avg_score, {dec('50 - global_avg_score', 2)}, 'C', '{GRADES[2][2]}', '50-65' FROM kpis""",
    "latest", "kpis"))
def score_vs_average(spark, sf):
    scored = scored_table(features(spark, sf))
    return scoring.score_vs_average(scored, SPEC, KEY).unionByName(scoring.score_vs_average(scored, SPEC, "nobody"))


@query("grade_distribution", sql(
    "SELECT grade, count(*) AS n, round(count(*) / (SELECT count(*) FROM board)::DOUBLE, 7) AS share FROM board GROUP BY grade", "board"))
def grade_distribution(spark, sf):
    board = stage(scoring.leaderboard(scored_table(features(spark, sf)), SPEC), "board")
    return show(scoring.grade_distribution(board), ["grade", "n"], ["share"])


@query("map_view", sql(
    f"""SELECT l.country, c.iso_code, l.year, l.{SCORE}, round(m.total_ghg, 7) AS total_ghg
        FROM latest l LEFT JOIN (SELECT DISTINCT country, iso_code FROM feat) c ON l.country = c.country
        LEFT JOIN (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1) m
          ON l.country = m.country WHERE c.iso_code IS NOT NULL AND m.total_ghg IS NOT NULL""", "latest"))
def map_view(spark, sf):
    rows = features(spark, sf)
    out = views.score_map(rows, scored_table(rows), SPEC, "total_ghg")
    return show(out, ["country", "iso_code", "year", SCORE], ["total_ghg"])


@query("score_trend", sql(f"SELECT country, year, {SCORE} FROM scored WHERE country IN ({SQL_KEYS})", "scored"))
def score_trend(spark, sf):
    return scoring.score_trend(scoring.score_panel(features(spark, sf), SPEC, breakdown=False), SPEC, KEYS)


@query("iso_lookup_join", sql(
    f"""SELECT l.country, l.year, l.{SCORE}, c.iso_code
        FROM latest l LEFT JOIN (SELECT DISTINCT country, iso_code FROM panel) c ON l.country = c.country""", "latest"))
def iso_lookup_join(spark, sf):
    rows = features(spark, sf)
    latest = windows.latest_per_key(scored_table(rows), SPEC, [SCORE])
    return joins.code_join(latest, panel(spark, sf), SPEC).select("country", "year", SCORE, "iso_code")


@query("latest_metric_join", sql(
    f"""SELECT l.country, l.year, l.{SCORE}, m.co2_per_capita
        FROM latest l LEFT JOIN (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1) m
          ON l.country = m.country""", "latest"))
def latest_metric_join(spark, sf):
    rows = features(spark, sf)
    latest = windows.latest_per_key(scored_table(rows), SPEC, [SCORE])
    out = joins.latest_metric_join(latest, rows, SPEC, "co2_per_capita")
    return out.select("country", "year", SCORE, "co2_per_capita")


# --- views ---------------------------------------------------------------

def _in_range(low, high):
    """The score blocks over part of the table, with the bounds of all of it."""
    chain = {"normed": ("feat, bounds", f"feat, bounds WHERE year BETWEEN {low} AND {high}"), "based": ("normed", "normed_r"),
             "scored": ("based", "based_r"), "latest": ("scored", "scored_r"), "kpis": ("latest", "latest_r")}
    return {f"{name}_r": CTES[name].replace(f"FROM {old}", f"FROM {new}") for name, (old, new) in chain.items()}


_OVERVIEW = f"""
SELECT l.country, {SCORE} AS score, {grade_case(SCORE, 1)} AS grade, {grade_case(SCORE, 2)} AS label, 'Co2' AS metric,
       m.co2 AS metric_value, global_avg_score, {dec(f'{SCORE} - global_avg_score', 2)} AS difference, {_BAND} AS band,
       countries_critical, countries_excellent, top_country, top_score
FROM latest_r l, kpis_r, (SELECT co2 FROM feat WHERE country = '{KEY}' AND year <= 2005 ORDER BY year DESC LIMIT 1) m
WHERE l.country = '{KEY}'"""


@query("view_overview", sql(_OVERVIEW, "feat", "bounds", **_in_range(1990, 2005)))
def view_overview(spark, sf):
    rows = features(spark, sf)
    return views.overview(rows, SPEC, scoring.indicator_fit(rows), KEY, "co2", 1990, 2005)


@query("view_trend", sql(
    f"""SELECT country, year, co2_per_capita AS value FROM feat
        WHERE country IN ({SQL_KEYS}) AND year BETWEEN 1990 AND 2005""", "feat"))
def view_trend(spark, sf):
    return views.trend(features(spark, sf), SPEC, "co2_per_capita", KEYS, 1990, 2005)


@query("view_map", sql(
    f"""SELECT 'best' AS side, * FROM (SELECT l.country, c.iso_code, {SCORE} FROM latest l
          LEFT JOIN (SELECT DISTINCT country, iso_code FROM feat) c ON l.country = c.country
          ORDER BY {SCORE} DESC, l.country, c.iso_code LIMIT 10)
        UNION ALL SELECT 'worst', * FROM (SELECT l.country, c.iso_code, {SCORE} FROM latest l
          LEFT JOIN (SELECT DISTINCT country, iso_code FROM feat) c ON l.country = c.country
          ORDER BY {SCORE}, l.country, c.iso_code LIMIT 10)""", "latest"))
def view_map(spark, sf):
    rows = features(spark, sf)
    return views.map_view(rows, scored_table(rows), SPEC).select("side", "country", "iso_code", SCORE)


@query("view_leaderboard", sql(
    f"""SELECT 'board' AS part, rank AS position, country, grade, {SCORE} AS value FROM board
        UNION ALL SELECT 'histogram', bin, NULL, NULL, CAST(n AS DOUBLE) FROM ({histogram_sql("board", SCORE, 30)})""", "board"))
def view_leaderboard(spark, sf):
    rows = features(spark, sf)
    return views.leaderboard_view(rows, SPEC, scoring.indicator_fit(rows))
