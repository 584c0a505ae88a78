"""Hand cases for repair, features, scores, joins and reports."""

import pytest
from pyspark.sql import functions as F

from panelloom.functions.exprs import clip, grade, label, score_severity, zscore_severity
from panelloom.operators import derive, filters, forecast, joins, repair, scoring, stats, windows
from panelloom.sources import tabular
from panelloom.spec import Indicator, Pillar
from panels import SPEC, panel

KV = "country string, year int, co2 double"


def _by(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_clean_leaves_no_feature_nulls(spark):
    out = repair.clean(panel(spark), SPEC, start=-100)
    assert out.where(" OR ".join(f"{c} IS NULL" for c in SPEC.features)).count() == 0
    assert {r.country for r in out.select("country").distinct().collect()} == {"hot", "two", "one", "gap"}
    assert out.where("gdp IS NULL").count() > 0


def test_changes_and_ratios(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("a", 5, 10.0), ("b", 1, 3.0)], KV)
    got = _by(derive.yoy_change(df, SPEC), "country", "year", "co2_yoy_change")
    assert got == {("a", 1): 0.0, ("a", 2): 0.0, ("a", 5): 100.0, ("b", 1): 0.0}
    rows = spark.createDataFrame([(10.0, 2.0, None, 3.0, None), (1.0, 9.0, 0.0, 0.0, 4.0), (0.0, 0.0, 0.0, 0.0, 0.0)],
                                 "co2 double, coal_co2 double, oil_co2 double, gas_co2 double, gdp double")
    out = [(round(r.fossil_ratio, 6), round(r.renewable_proxy, 6), r.co2_intensity) for r in derive.ratio_columns(rows).collect()]
    assert out == [(0.5, 0.5, None), (1.0, 0.0, pytest.approx(0.25)), (0.0, 1.0, 0.0)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 1.0, 0.0]


def test_scalers_on_constant_columns(spark):
    df = spark.createDataFrame([("a", 1, 4.0, None), ("a", 2, 4.0, 1.0), ("a", 3, 4.0, 3.0)], KV + ", x double")
    out = derive.minmax_normalise(df, SPEC).orderBy("year").collect()
    assert [(r.co2, r.x) for r in out] == [(0.0, None), (0.0, 0.0), (0.0, 1.0)]
    scaled = derive.standard_scale(df, ["co2"]).collect()
    assert {r.co2 for r in scaled} == {0.0}


def test_lag_features_identity_and_leak(spark):
    df = spark.createDataFrame([("a", t, float(t * t)) for t in range(12)], KV)
    out = derive.lag_features(df, SPEC).collect()
    assert [r.year for r in sorted(out, key=lambda r: r.year)] == list(range(5, 12))
    assert all(r.co2_lag1 + r.co2_diff1 == r.co2 for r in out)
    past = {r.year: r for r in derive.lag_features(df, SPEC, leaky=False).collect()}
    assert past[8].co2_diff1 == 49 - 36 and past[8].co2_rolling3 == pytest.approx((49 + 36 + 25) / 3)


def test_zscore_edges(spark):
    df = spark.createDataFrame([("a", t, 7.0) for t in range(4)] + [("b", 0, 1.0), ("b", 1, 1.0)], KV)
    out = windows.detect_key_series(df, SPEC).collect()
    assert {r.country for r in out} == {"a"}
    assert sorted((r.year, r.zscore, r.zscore_anomaly) for r in out)[0] == (0, None, False)
    assert {r.zscore for r in out if r.year > 0} == {0.0}
    assert windows.detect_key_series(df, SPEC, "absent") is df


def test_severities(spark):
    df = spark.createDataFrame([(-0.05,), (-0.10,), (-0.15,), (-0.25,), (-0.4,), (None,)], "s double")
    assert [r[0] for r in df.select(score_severity(F.col("s"))).collect()] == [
        "normal", "normal", "medium", "high", "critical", "normal"]
    z = spark.createDataFrame([(2.5,), (-2.6,), (4.0,), (-5.1,), (None,)], "z double")
    assert [r[0] for r in z.select(zscore_severity(F.col("z"), 2.5)).collect()] == [
        "normal", "medium", "high", "critical", "normal"]


def test_grades_on_the_cuts(spark):
    df = spark.createDataFrame([(80.0,), (79.99,), (65.0,), (50.0,), (35.0,), (34.99,)], "s double")
    assert "".join(r[0] for r in df.select(grade(F.col("s"))).collect()) == "ABBCDF"
    assert df.select(label(F.col("s"))).first()[0].startswith("Excellent")


INDICATORS = (Indicator("A", "a", 3.0), Indicator("B", "b", 1.0, lower_is_better=False), Indicator("C", "missing", 6.0))


def _scored(spark, rows, bounds="0.0 a_low, 10.0 a_high, 0.0 b_low, 100.0 b_high"):
    df = spark.createDataFrame(rows, "country string, year int, a double, b double")
    fitted = spark.range(1).selectExpr(*[f"CAST({p.rsplit(' ', 1)[0]} AS DOUBLE) AS {p.rsplit(' ', 1)[1]}" for p in bounds.split(", ")])
    return df, fitted


def test_score_renormalises_over_known_indicators(spark):
    df, fitted = _scored(spark, [("x", 1, 2.0, 50.0), ("x", 2, None, 25.0), ("y", 1, None, None), ("z", 1, -5.0, 500.0)])
    out = scoring.base_score(df, fitted, INDICATORS)
    assert _by(out, "country", "year", scoring.SCORE) == {
        ("x", 1): 72.5, ("x", 2): 25.0, ("y", 1): 50.0, ("z", 1): 100.0}
    parts = {(r.country, r.year): dict(r.breakdown) for r in scoring.breakdown_map(out, INDICATORS).collect()}
    assert parts["x", 1] == {"A": 80.0, "B": 50.0} and parts["x", 2] == {"B": 25.0} and parts["y", 1] == {}


def test_norm_without_range_is_half(spark):
    df, fitted = _scored(spark, [("x", 1, 2.0, 3.0)], "4.0 a_low, 4.0 a_high")
    row = scoring.indicator_norm(df, fitted, INDICATORS).first()
    assert (row.norm_a, row.norm_b) == (0.5, 0.5)


def test_trend_bonus_is_clamped(spark):
    df = spark.createDataFrame([("x", 1, 50.0), ("x", 2, 70.0), ("x", 4, 69.0), ("y", 1, 99.9), ("y", 2, 100.0)],
                               f"country string, year int, {scoring.SCORE} double")
    out = scoring.trend_bonus(df, SPEC)
    assert _by(out, "country", "year", scoring.SCORE) == {
        ("x", 1): 50.0, ("x", 2): 71.5, ("x", 4): 68.7, ("y", 1): 99.9, ("y", 2): 100.0}
    assert _by(out, "country", "year", "score_yoy_change")["x", 2] == 20.0


def test_leaderboard_ranks_ties_by_key(spark):
    scored = spark.createDataFrame([("b", 2, 70.0), ("a", 2, 70.0), ("c", 1, 90.0), ("c", 2, 10.0)],
                                   f"country string, year int, {scoring.SCORE} double")
    got = [(r["rank"], r.country, r.grade) for r in sorted(scoring.leaderboard(scored, SPEC).collect(), key=lambda r: r["rank"])]
    assert got == [(1, "a", "B"), (2, "b", "B"), (3, "c", "F")]
    assert [r.country for r in scoring.leaderboard(scored, SPEC, year=1).collect()] == ["c"]
    assert scoring.leaderboard(scored, SPEC, year=0).count() == 0
    kpi = stats.global_kpis(scored, SPEC).first()
    assert (kpi.global_avg_score, kpi.top_country, kpi.bottom_country, kpi.countries_critical) == (50.0, "a", "c", 1)


def test_pillars(spark):
    pillars = (Pillar("P", ("a", "b"), 0.5), Pillar("Q", ("missing",), 0.5))
    df, fitted = _scored(spark, [("x", 1, 10.0, None), ("y", 1, 0.0, 100.0), ("z", 1, None, None)])
    out = scoring.pillar_score(df, SPEC, fitted, pillars)
    assert {r.country: (r.pillar_P, r.pillar_Q, r.composite_score) for r in out.collect()} == {
        "x": (0.0, 50.0, 25.0), "y": (50.0, 50.0, 50.0), "z": (50.0, 50.0, 50.0)}


def test_two_codes_give_two_rows(spark):
    scores = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "country string, s double")
    codes = spark.createDataFrame([("x", "AAA"), ("x", "BBB"), ("x", "AAA")], "country string, iso_code string")
    got = sorted((r.country, r.iso_code or "") for r in joins.code_join(scores, codes, SPEC).collect())
    assert got == [("x", "AAA"), ("x", "BBB"), ("y", "")]


def test_metric_choice(spark):
    df = spark.createDataFrame([("x", 1.0)], "country string, co2 double")
    assert filters.metric_column(df, "co2") == "co2" and filters.metric_column(df, "total_ghg", "co2") == "co2"
    with pytest.raises(ValueError):
        filters.metric_column(df, "country")


def test_key_membership(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "country string, year int")
    keys = spark.createDataFrame([("x",), ("x",), ("z",)], "country string")
    assert filters.key_in_table(df, SPEC, keys).count() == filters.key_in_list(df, SPEC, ["x", "z"]).count() == 2


def test_year_range_default(spark):
    df = spark.createDataFrame([("x", 1995), ("x", 2001)], "country string, year int")
    assert [r.year for r in filters.year_range(df, SPEC).collect()] == [2001]
    assert filters.year_range(df, SPEC, floor=1900).count() == 2


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.csv").write_text(" Country ,ISO_Code,YEAR,co2,note\nx,AAA,1990,1.5,n\ny,,1991,NaN,m\nz,CCC,1992,,\n")
    rows = tabular.scan_csv(spark, path).orderBy("year").collect()
    assert [tuple(r) for r in rows] == [("x", "AAA", 1990, 1.5), ("y", None, 1991, None), ("z", "CCC", 1992, None)]


def test_global_trend_is_contiguous(spark):
    df = spark.createDataFrame([("a", 2000 + t, float(t)) for t in range(6)] + [("b", 2001, None)], KV)
    out = sorted((r.year, r.type, r.co2) for r in forecast.global_trend(df, SPEC, horizon=3).collect())
    assert [r[0] for r in out] == list(range(2000, 2009))
    # The level starts at the first value and the second only sets the trend, so it lags.
    level, trend = 0.0, 1.0
    for x in (2.0, 3.0, 4.0, 5.0):
        newer = 0.3 * x + 0.7 * (level + trend)
        level, trend = newer, 0.1 * (newer - level) + 0.9 * trend
    assert out[6][1:] == ("forecast", pytest.approx(level + trend))


def test_correlation_and_shares(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, None)], "a double, b double, c double")
    corr = _by(stats.corr_matrix(df, ["a", "b", "c"]), "a", "b", "corr")
    assert corr["a", "b"] == corr["b", "a"] == pytest.approx(1.0) and corr["a", "c"] is None and corr["c", "c"] is None
    assert _by(stats.missing_share(df, ["a", "c"]), "column", "share") == {("a",): 0.0, ("c",): pytest.approx(2 / 3)}


def test_latest_rows_are_limited_before_the_shuffle(spark):
    from panelloom.operators import windows
    from panels import SPEC, panel

    rows = panel(spark)
    latest = windows.latest_per_key(rows, SPEC)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan
    want = {}
    for r in rows.collect():
        if r.country not in want or r.year > want[r.country].year:
            want[r.country] = r
    assert {r.country: r.year for r in latest.collect()} == {k: r.year for k, r in want.items()}


def test_nan_is_null_at_every_source(spark, tmp_path):
    from panelloom.sources import tabular

    df = spark.createDataFrame([("a", float("nan"), 1), ("b", 2.0, 2)], "Country string, co2 double, year int")
    df.write.parquet(str(tmp_path / "p"))
    df.write.orc(str(tmp_path / "o"))
    for kind, path in (("parquet", "p"), ("orc", "o")):
        got = tabular.scan_panel(spark, str(tmp_path / path), kind)
        assert sorted((r.country, r.co2) for r in got.collect()) == [("a", None), ("b", 2.0)]


def test_staged_tables_are_reused_by_input_state(spark, tmp_path):
    from panelloom.sources import storage

    built, source = [], str(tmp_path / "t")

    def build():
        built.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert [storage.reused(spark, "three", [source], build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(source)
    assert storage.reused(spark, "three", [source], build).count() == 4 and len(built) == 2
