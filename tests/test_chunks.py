"""Chunked windows must equal plain per-key windows, whatever the span."""

import pytest
from pyspark.sql import Window, functions as F

from panelloom.operators import chunks, derive, forecast, repair, windows
from panels import SPEC, collected, panel

SPANS = [1, 3, 16, 1000]
FEATURES = list(SPEC.features)


@pytest.fixture(scope="module")
def rows(spark):
    return panel(spark).cache()


@pytest.mark.parametrize("span", SPANS)
def test_look_back_equals_plain_window(rows, span):
    spec = SPEC.with_span(span)
    w = Window.partitionBy("country").orderBy("year")
    ours = chunks.over_history(rows, spec, 4, {
        "a": lambda v: F.lag("co2", 3).over(v), "b": lambda v: F.avg("co2").over(v.rowsBetween(-4, 0))})
    plain = rows.withColumns({"a": F.lag("co2", 3).over(w), "b": F.avg("co2").over(w.rowsBetween(-4, 0))})
    pick = ["country", "year", "a", "b"]
    assert collected(ours.select(pick)) == collected(plain.select(pick))


@pytest.mark.parametrize("span", SPANS)
def test_fill_equals_plain_window(rows, span):
    w = Window.partitionBy("country").orderBy("year")
    forward = w.rowsBetween(Window.unboundedPreceding, 0)
    backward = w.rowsBetween(0, Window.unboundedFollowing)
    ff = {c: F.last(c, True).over(forward) for c in FEATURES}
    bf = {c: F.coalesce(F.last(c, True).over(forward), F.first(c, True).over(backward)) for c in FEATURES}
    spec = SPEC.with_span(span)
    pick = ["country", "year", *FEATURES]
    assert collected(repair.ffill(rows, spec).select(pick)) == collected(rows.withColumns(ff).select(pick))
    assert collected(repair.bfill(rows, spec).select(pick)) == collected(rows.withColumns(bf).select(pick))


@pytest.mark.parametrize("span", SPANS)
def test_positions_and_totals(rows, span):
    spec = SPEC.with_span(span)
    got = chunks.positions(rows, spec).select("country", "year", "_pos", "_rows")
    w = Window.partitionBy("country")
    want = rows.select("country", "year", F.row_number().over(w.orderBy("year")) - 1, F.count("*").over(w))
    assert collected(got) == collected(want)
    kept = windows.enough_history(rows, spec, 7)
    assert {r.country for r in kept.select("country").distinct().collect()} == {"hot", "gap", "void", "area"}


def test_every_span_gives_the_same(rows):
    for build in (lambda s: derive.pipeline(rows, s, -100),
                  lambda s: windows.rolling_zscore(rows, s, threshold=0.75),
                  lambda s: windows.sequence_windows(rows.na.fill(0.0), s, ["co2", "gdp"]).select("country", "year", "sequence"),
                  lambda s: windows.timeseries_folds(rows.select("country", "year"), s),
                  lambda s: derive.lag_features(rows, s, leaky=False, required=["co2_lag1"]),
                  lambda s: forecast.holt_fit(rows, s)):
        assert collected(build(SPEC.with_span(8)), 7) == collected(build(SPEC), 7)


def test_pipeline_reads_once_and_exchanges_rows_twice_at_most(spark, rows, tmp_path):
    """Later passes read what the first one wrote; exchanges of whole rows are on (key, chunk)."""
    rows.write.parquet(str(tmp_path / "source"))
    out = derive.pipeline(spark.read.parquet(str(tmp_path / "source")), SPEC.with_span(8), -100)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "source") not in out._jdf.queryExecution().toString()
    lines = plan.split("\n")
    dealt = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(country" in line and "_chunk" in line]
    assert 1 <= sum("HashAggregate" not in below for below in dealt) <= 2, plan  # the others carry the table of chunks


def test_holt_matches_the_recurrence(rows):
    got = {r.country: (r.last_year, r.level, r.trend) for r in forecast.holt_fit(rows, SPEC.with_span(5)).collect()}
    series = {}
    for r in sorted(rows.collect(), key=lambda r: r.year):
        if r.co2 is not None:
            series.setdefault(r.country, []).append((r.year, r.co2))
    for key, points in series.items():
        if len(points) < 2:
            assert key not in got
            continue
        v = [p[1] for p in points]
        level, trend = v[0], v[1] - v[0]
        for x in v[2:]:
            newer = 0.3 * x + 0.7 * (level + trend)
            level, trend = newer, 0.1 * (newer - level) + 0.9 * trend
        assert got[key] == (points[-1][0], pytest.approx(level), pytest.approx(trend))


def test_history_rows_are_bounded(rows):
    spec = SPEC.with_span(4)
    extra = chunks.with_history(rows, spec, 3).where(chunks.HISTORY)
    cells = chunks.cells(rows, spec)
    assert extra.count() <= 3 * cells.count()
    most = chunks.with_history(rows, spec, 3).groupBy("country", chunks.CHUNK).count().agg(F.max("count")).first()[0]
    assert most <= 4 + 3


def test_same_result_after_repartition(rows):
    one = derive.pipeline(rows, SPEC.with_span(8), -100)
    two = derive.pipeline(rows.repartition(1), SPEC.with_span(8), -100)
    assert collected(one) == collected(two)
