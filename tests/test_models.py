"""Isolation forest, sequence errors and tree forecasts: invariants and hand cases."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import forecast, forest, isolation, sequences, trees
from panelloom.plans.oracle import forest_blocks
from panelloom.sources.models import load_model, save_model
from panelloom.spec import PanelSpec

SPEC = PanelSpec(features=("a", "b"))


def _points(spark, odd=5, n=600):
    rng = random.Random(5)
    rows = [(f"k{i % 7}", i // 7, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(n)]
    rows += [("odd", i, 60.0 + i, -90.0 - i) for i in range(odd)]
    return spark.createDataFrame(rows, "country string, year int, a double, b double")


def _fit(df, **kw):
    return isolation.iforest_fit(df, SPEC, features=("a", "b"), trees=60, **kw)


def test_forest_finds_planted_rows(spark):
    df = _points(spark)
    model = _fit(df)
    out = isolation.detect_global(df, model).cache()
    low, high = out.agg(F.min("if_score"), F.max("if_score")).first()
    assert -1 <= low and high < 0
    assert {r.country for r in out.orderBy("if_score").limit(5).collect()} == {"odd"}
    flagged = out.where("is_anomaly").count()
    assert abs(flagged - 0.05 * 605) <= 1.5
    assert out.where("is_anomaly <> (if_flag = -1)").count() == 0
    shape = model.nodes.groupBy("tree").agg(F.max("depth").alias("d"), F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("n"))
    assert shape.count() == 60 and shape.where("d > 8 OR n > 256").count() == 0


def test_forest_does_not_depend_on_partitions(spark, tmp_path):
    df = _points(spark)
    key = lambda d, m: sorted((r.country, r.year, r.if_score) for r in isolation.detect_global(d, m).collect())
    one = key(df, _fit(df))
    model = _fit(df.repartition(11))
    assert [r[:2] for r in one] == [r[:2] for r in key(df, model)]
    assert np.allclose([r[2] for r in one], [r[2] for r in key(df, model)])
    save_model(model, str(tmp_path / "m"))
    assert key(df, model) == key(df, load_model(spark, str(tmp_path / "m")))


@pytest.mark.parametrize("rows", [40, 900, 200_000])
def test_sample_is_drawn_alike_at_every_size(spark, rows):
    """Every tree gets the sample in full, and a row may be in several trees."""
    df = spark.range(rows).select(F.col("id").alias("k"), F.rand(1).alias("x"))
    drawn = isolation.draw(df, ["k"], 20, 64, 42)
    sizes = drawn.groupBy("tree").count()
    assert sizes.count() == 20 and tuple(sizes.agg(F.min("count"), F.max("count")).first()) == (min(rows, 64),) * 2
    assert drawn.count() == drawn.select("tree", "k").distinct().count() > drawn.select("k").distinct().count()


def _digits(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def _drawn(rows, trees, sample, seed):
    """The rows of each tree, one row after another."""
    share = isolation.SPARE * sample / len(rows)
    while True:
        bounds = isolation.entries(trees, share) if share < 1 else []
        found = {t: [] for t in range(trees)}
        for row in rows:
            at = int(_digits(*row, seed)[:13], 16)
            number = sum(b <= at for b in bounds) if share < 1 else trees
            got = []
            for j in range(trees - number + 1, trees + 1):
                t = int(_digits(*row, seed, "enters", j)[:8], 16) % j + 1
                got.append(j if t in got else t)
            for t in got:
                found[t - 1].append((_digits(*row, seed, t - 1), row))
        if share >= 1 or all(len(x) >= sample for x in found.values()):
            return [(t, row) for t, x in found.items() for _, row in sorted(x)[:sample]]
        share *= 2


@pytest.mark.parametrize("trees, sample, rows", [(4, 64, 6000), (60, 1, 3000), (200, 256, 300), (200, 256, 500), (200, 256, 5000)])
def test_every_tree_draws_from_all_rows(spark, trees, sample, rows):
    """Few rows and many; with samples of one row some trees come out short at first."""
    df = spark.range(rows).selectExpr("concat('k', id % 7) AS country", "id div 7 AS year", "id AS a").repartition(5)
    got = isolation.draw(df, ["country", "year"], trees, sample, 42).select("tree", "country", "year").collect()
    want = _drawn([(f"k{i % 7}", i // 7) for i in range(rows)], trees, sample, 42)
    assert sorted(map(tuple, got)) == sorted((t, *row) for t, row in want)
    if sample > 1:  # the statement does not raise the share
        blocks = forest_blocks("feat", ("a",), trees, sample, 42)
        feat = f"SELECT concat('k', CAST(i % 7 AS VARCHAR)) AS country, i // 7 AS year, i AS a FROM range({rows}) r(i)"
        parts = ", ".join(f"{n} AS ({blocks[n]})" for n in ("fx", "fn", "fb", "fp", "fe", "fs0"))
        stated = duckdb.sql(f"WITH RECURSIVE feat AS ({feat}), {parts} SELECT tree, CAST(x0 AS BIGINT) FROM fs0").fetchall()
        assert sorted((r.tree, 7 * r.year + int(r.country[1:])) for r in got) == sorted(stated)


def test_trees_enter_with_equal_chance_and_few_hashes(spark):
    """Entries follow the binomial distribution, for each tree alike; a row's plan has one hash and one for each entry."""
    rows, trees, share = 40_000, 200, 0.01
    df = spark.range(rows).select("id", isolation.entered([F.col("id")], trees, share, 7).alias("got"))
    counts = df.groupBy(F.coalesce(F.size("got"), F.lit(0)).alias("k")).count().collect()
    found = {max(r.k, 0): r["count"] for r in counts}
    for k in range(5):
        expected = rows * math.comb(trees, k) * share ** k * (1 - share) ** (trees - k)
        assert abs(found[k] - expected) < 5 * math.sqrt(expected)
    each = df.select(F.explode("got").alias("tree")).groupBy("tree").count().collect()
    assert len(each) == trees and all(abs(r["count"] - rows * share) < 6 * math.sqrt(rows * share) for r in each)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("md5(") == 2


def test_path_constant():
    assert isolation.path_constant([1, 2]).tolist() == [0.0, 1.0]
    assert isolation.path_constant(256) == pytest.approx(10.244770920)


@pytest.mark.parametrize("rank", [2, 5, 9])
def test_leading_subspace(rank):
    """The steps find the directions of largest variance; a table of lower rank has no further ones."""
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(400, rank)) * 3.0 ** -np.arange(rank) @ rng.normal(size=(rank, 9))
    products = x.T @ x
    basis = sequences.leading_subspace(products, 4, steps=200)
    found = min(rank, 4)
    assert np.allclose(basis[:found] @ basis[:found].T, np.eye(found), atol=1e-9) and not basis[found:].any()
    best = np.linalg.eigh(products)[1][:, ::-1][:, :found]
    assert np.allclose(basis.T @ basis, best @ best.T, atol=1e-6)


def test_sequences_without_a_run(spark):
    df = spark.createDataFrame([("k", t, 1.0 * t, 2.0) for t in range(3)], "country string, year int, a double, b double")
    assert [(r.lstm_error, r.lstm_anomaly) for r in sequences.sequence_error(df, SPEC, features=("a", "b")).collect()] == [(0.0, False)] * 3


def test_sequence_error(spark):
    rng = random.Random(2)
    rows = [("k", t, float(t % 5), 3.0 * (t % 5) + rng.gauss(0, 0.01)) for t in range(60)]
    rows[40] = ("k", 40, 50.0, -70.0)
    rows += [("short", t, 1.0, 2.0) for t in range(3)]
    df = spark.createDataFrame(rows, "country string, year int, a double, b double")
    out = {(r.country, r.year): r for r in sequences.sequence_error(df, SPEC, latent=3, features=("a", "b")).collect()}
    assert len(out) == 63
    assert all(out["k", t].lstm_error == 0 and not out["k", t].lstm_anomaly for t in range(4))
    assert all(out["short", t].lstm_error == 0 for t in range(3))
    assert any(out["k", t].lstm_anomaly for t in range(40, 45))


def _series(spark):
    rows = [(k, t, 100.0, 10.0, base + slope * t) for k, base, slope in (("up", 10.0, 2.0), ("down", 90.0, -1.0))
            for t in range(1990, 2010)]
    rows += [("brief", t, 1.0, 1.0, 5.0) for t in range(2000, 2004)]
    return spark.createDataFrame(rows, "country string, year int, population double, gdp double, co2 double")


def test_ensemble(spark):
    df = _series(spark)
    out = trees.ensemble_forecast(df, PanelSpec(), horizon=3, trees=5, depth=5)
    past = out.where("type = 'historical'")
    assert past.count() == 40 and past.where("model = 'historical' and year < 2010").count() == 40
    table = {(r.country, r.year, r.model): r.predicted for r in out.where("type = 'forecast'").collect()}
    assert {k[0] for k in table} == {"up", "down"} and {k[1] for k in table} == {2010, 2011, 2012}
    for key in ("up", "down"):
        for year in (2010, 2011, 2012):
            members = [table[key, year, m] for m in ("rf", "gbm", "holt")]
            assert min(members) <= table[key, year, "ensemble"] <= max(members)
            assert table[key, year, "ensemble"] == pytest.approx(sum(members) / 3)
    assert table["up", 2011, "holt"] - table["up", 2010, "holt"] == pytest.approx(2.0, abs=0.3)
    assert table["up", 2010, "gbm"] == pytest.approx(10 + 2.0 * 2007 + 2.0)


def test_feature_importance_and_folds(spark):
    df = _series(spark)
    fitted = trees.forest_fit(df, PanelSpec(), trees=5, depth=4)
    rows = trees.feature_importance(fitted).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0) and len(rows) == 10
    cv = trees.boosting_cv(df, PanelSpec(), rounds=3).first()
    assert cv.folds == 3 and cv.mae_mean > 0


def test_projection_of_short_keys(spark):
    df = spark.createDataFrame([("one", 2000, 4.0), ("two", 2000, 4.0), ("two", 2003, 10.0)],
                               "country string, year int, co2 double")
    got = {(r.country, r.year): r.predicted for r in forecast.trend_projection(df, SPEC, horizon=1).collect()}
    assert got == {("one", 2001): None, ("two", 2004): 13.0}


def _walk(nodes, tree, x):
    place = 1
    while nodes[tree, place].feature >= 0:
        place = 2 * place + (x[nodes[tree, place].feature] > nodes[tree, place].threshold)
    return nodes[tree, place].value


def test_forest_forecast_equals_a_plain_walk(spark):
    """One key after another, one step after another; a key may know fewer values than the longest lag."""
    df = _series(spark)
    fitted = trees.forest_fit(df, PanelSpec(), trees=4, depth=6)
    nodes = {(r.tree, r.node): r for r in fitted.nodes.collect()}
    got = {(r.country, r.year): r.predicted for r in trees.forest_forecast(df, PanelSpec(), fitted, horizon=7).collect()}
    assert fitted.inputs == (*trees.lag_names("co2"), "year", "population", "gdp")
    want, rows = {}, {}
    for r in df.collect():
        rows.setdefault(r.country, []).append(r)
    for key, held in rows.items():
        held = sorted(held, key=lambda r: r.year)
        v = [r.co2 for r in held][-5:]
        for step in range(1, 8):
            back = lambda k: v[-k] if len(v) >= k else v[-1]
            mean = lambda k: sum(v[-k:]) / len(v[-k:])
            x = [back(1), back(2), back(3), back(5), back(1) - back(2), mean(3), mean(5), held[-1].year + step, held[-1].population, held[-1].gdp]
            want[key, held[-1].year + step] = sum(_walk(nodes, t, x) for t in range(4)) / 4
            v = [*v, want[key, held[-1].year + step]][-5:]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_forest_leaves_and_draws(spark):
    """Leaves hold every draw once; draws are Poisson for each tree, whatever the size of the table."""
    df = _series(spark)
    fitted = trees.forest_fit(df, PanelSpec(), trees=20, depth=30)
    rows = trees.training_rows(df, PanelSpec(), "co2", ["population", "gdp"], False).count()
    facts = trees.forest_trees(fitted).collect()
    leaves = fitted.nodes.where("feature < 0").count()
    assert len(facts) == 20 and sum(r.nodes for r in facts) == 2 * leaves - 20
    assert abs(sum(r.rows for r in facts) - 20 * rows) < 5 * math.sqrt(20 * rows)
    wide = spark.range(50_000).select(F.explode(forest.draws([F.col("id")], 30, 0.02, 1)).alias("tree")).groupBy("tree").count().collect()
    assert len(wide) == 30 and all(abs(r["count"] - 1000) < 6 * math.sqrt(1000) for r in wide)
    fits = fitted.metrics.first()
    assert fits.n == rows and fits.r2 > 0.95


def test_boosting_lowers_the_error_round_by_round(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(f"k{i % 5}", 1960 + i // 5, 20.0 * (i % 5) + (i // 5) % 7 + rng.gauss(0, 0.1)) for i in range(300)],
                               "country string, year int, co2 double")
    base = sorted(trees.boosting_folds(df, PanelSpec()).collect())
    assert [r.fold for r in base] == [1, 2, 3] and all(r.test == 5 * (55 // 4) for r in base)
    mean = sum(r.mae for r in base) / 3
    errors = [trees.boosting_cv(df, PanelSpec(), rounds=k).first() for k in (0, 1, 200)]
    assert errors[0].mae_mean == pytest.approx(mean) and errors[0].folds == 3
    assert errors[2].mae_mean < 0.2 * mean and errors[2].mae_mean < errors[1].mae_mean < mean
    assert trees.boosting_cv(df.limit(0), PanelSpec()).first().folds == 0


def test_boosting_equals_a_plain_loop():
    """One group, one tree after another, cuts tried one by one."""
    rng = np.random.default_rng(3)
    n, cuts = 40, [[0.2, 0.5, 0.7], [0.1, 0.6]]
    rows = pd.DataFrame({"tree": 2, "k": np.arange(n), "a": rng.random(n), "b": rng.random(n)})
    rows["y"] = rows.a * 3 + (rows.b > 0.6) + rng.normal(0, 0.01, n)
    got = forest.boost(["k"], "y", ["a", "b"], cuts, 5, 0.3, 2, 1.0, 1)(rows.sample(frac=1, random_state=1))
    now = np.full(n, rows.y.mean())
    x = rows[["a", "b"]].to_numpy()
    for k in range(1, 6):
        r, step = rows.y.to_numpy() - now, np.zeros(n)

        def split(some, level):
            best = None
            for f, ts in enumerate(cuts):
                for t in ts:
                    left = some & (x[:, f] <= t)
                    right = some & ~left
                    if left.any() and right.any():
                        gain = r[left].sum() ** 2 / left.sum() + r[right].sum() ** 2 / right.sum()
                        if best is None or gain > best[0] + 1e-12:
                            best = gain, left, right
            if level == 2 or best is None or best[0] <= r[some].sum() ** 2 / some.sum():
                step[some] = 0.3 * r[some].mean()
            else:
                split(best[1], level + 1)
                split(best[2], level + 1)

        split(np.ones(n, bool), 0)
        now = now + step
        leaves = got[(got["round"] == k) & (got.feature < 0)]
        assert sorted(leaves.value) == pytest.approx(sorted(set(step)), abs=1e-9)


def test_forest_of_no_rows_and_of_one_value(spark):
    schema = "country string, year int, population double, gdp double, co2 double"
    none = trees.forest_fit(spark.createDataFrame([], schema), PanelSpec(), trees=3)
    assert none.nodes.count() == 0 and none.metrics.first()["n"] == 0
    flat = spark.createDataFrame([("k", 1990 + t, 1.0, 2.0, 7.0) for t in range(12)], schema)
    fitted = trees.forest_fit(flat, PanelSpec(), trees=3)
    assert {r.value for r in fitted.nodes.collect()} == {7.0} and fitted.nodes.count() <= 3
    assert {r.predicted for r in trees.forest_forecast(flat, PanelSpec(), fitted, 2).collect()} == {7.0}


def test_forest_errors_cover_rows_outside_the_sample(spark):
    df = spark.createDataFrame([(f"k{i % 10}", 1990 + i // 10, float(i % 17)) for i in range(300)], "country string, year int, co2 double")
    rows = trees.training_rows(df, PanelSpec(), "co2", [], False).count()
    fitted = trees.forest_fit(df, PanelSpec(), trees=2, depth=3, most_rows=rows // 2)
    assert rows > 200 and fitted.metrics.first()["n"] == rows
