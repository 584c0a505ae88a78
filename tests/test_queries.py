"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, database

# One or two queries per operator group; the full list runs with tests/compare.py.
CHECKED = ["scan_csv", "frame_sample", "coerce_numeric", "clean", "pipeline_run", "lag_features", "rolling_zscore",
           "quantile_bounds", "describe", "severity_sort", "leaderboard", "pillar_score", "global_kpis", "map_view",
           "holt_forecast", "global_trend", "iforest_flag", "detection_report", "analyse_images", "image_regions"]


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, con, name):
    df = entry_points.queries()[name](spark, sf)
    assert compare(df, con, entry_points.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark, sf):
    df = entry_points.entry(spark)
    assert df.columns == ["rank", "country", "year", "sustainability_score", "grade", "label"] and df.count() > 0
