"""Quantiles, histograms and ranks against numpy and the built-in percentile."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import ordering, quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.98, 1.0]


def _values(kind, n=1500):
    rng = random.Random(3)
    return {
        "smooth": [rng.gauss(0, 10) for _ in range(n)],
        "heavy": [0.0] * (n // 2) + [rng.lognormvariate(0, 6) * rng.choice((1, -1)) for _ in range(n // 2)],
        "narrow": [1000 + rng.random() * 1e-9 for _ in range(n)],
        "tiny": [rng.random() * 1e-300 for _ in range(n)],
        "huge": [rng.choice((1, -1)) * 1.7e308 * rng.random() for _ in range(n)],
        "copies": [3.5] * n,
        "single": [42.0],
    }[kind]


@pytest.mark.parametrize("kind", ["smooth", "heavy", "narrow", "tiny", "huge", "copies", "single"])
def test_quantiles_are_exact(spark, kind):
    v = _values(kind)
    bad = [None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in v + bad], "x double").repartition(6)
    got = {r.prob: r.value for r in quantiles.quantiles(df, ["x"], PROBS).collect()}
    if kind != "huge":  # differences of the largest doubles overflow in both references
        for p in PROBS:
            assert got[p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=0)
    ordered = sorted(v)
    assert got[0.0] == ordered[0] and got[1.0] == ordered[-1]


def test_quantiles_of_several_columns(spark):
    df = spark.createDataFrame([(float(i), float(-i * i), None) for i in range(101)], "a double, b double, c double")
    rows = {(r.column, r.prob): (r.value, r.n) for r in quantiles.quantiles(df, ["a", "b", "c"], [0.1, 0.5]).collect()}
    assert rows == {("a", 0.1): (10.0, 101), ("a", 0.5): (50.0, 101), ("b", 0.1): (-8100.0, 101), ("b", 0.5): (-2500.0, 101)}
    one = quantiles.quantile_row(df, ["a", "c"], {"mid": 0.5}).first()
    assert one.a_mid == 50.0 and one.c_mid is None


@pytest.mark.parametrize("rows", [0, 1, 2, 10, 150_000])
def test_quantiles_have_the_bits_of_percentile(spark, rows):
    """Smooth values, and values of which one holds a third of all rows."""
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7
    df = spark.range(rows).repartition(5).select(share.alias("a"), F.when(F.col("id") % 3 == 0, 4.25).otherwise(share).alias("b"))
    probs = [0.0, 0.02, 0.25, 1 / 3, 0.5, 0.77, 0.98, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "ab"]).first()
    got = quantiles.quantile_row(df, ["a", "b"], {f"p{i}": p for i, p in enumerate(probs)}).first()
    for c in "ab":
        assert [got[f"{c}_p{i}"] for i in range(len(probs))] == (want[c] or [None] * len(probs))


def test_descent_holds_a_fixed_number_of_rows(spark):
    """Lists and ranges stay as small at 1,000,000 rows as at 10,000; many close values, and one that a third shares."""
    probs, most, passes = [0.01, 0.25, 0.5, 0.75, 0.99], 64, {}
    for n in (10_000, 1_000_000):
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)
        close = F.when(F.col("id") % 3 == 0, 1.5).otherwise(1 + share * 1e-3)
        df = spark.range(0, n, 1, 6).select(close.alias("a"), F.exp(share * 900 - 450).alias("b"))
        log = []
        sizes, values = quantiles.order_statistics(df, ["a", "b"], probs, few=most, log=log)
        assert sizes == {"a": n, "b": n}
        assert max(listed for _, listed in log) <= most and max(ranges for ranges, _ in log) <= 2 * 2 * len(probs)
        rows = df.toPandas()
        for c in "ab":
            ordered = np.sort(rows[c].to_numpy())
            for p in probs:
                for k in (int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1)))):
                    assert values[c, k] == ordered[k]
        passes[n] = sum(listed == 0 for _, listed in log)
    assert max(passes.values()) <= quantiles.PASSES


@pytest.mark.parametrize("few", [0, 1, 4096])
def test_descent_keeps_every_bit(spark, few):
    """Neighbouring doubles around powers of two, subnormal ones, the ends of the range, both zeros."""
    ends = [2.0 ** k for k in (-1074, -1073, -1022, -1021, -52, -1, 0, 1, 52, 53, 1022, 1023)] + [1.7976931348623157e308, 0.1, 1 / 3, 1e-310]
    v = [s * x for x in ends for s in (1, -1)] + [0.0, -0.0, 0.0]
    v += [float(np.nextafter(x, t)) for x in v for t in (0.0, math.inf) if abs(x) < 1.7e308]
    df = spark.createDataFrame([(x,) for x in v], "x double").repartition(4)
    probs = [k / (len(v) - 1) for k in range(len(v))]
    sizes, values = quantiles.order_statistics(df, ["x"], probs, few=few)
    assert sizes == {"x": len(v)} and [values["x", k] for k in range(len(v))] == sorted(v)


def test_describe_reads_rows_as_they_stand(spark):
    from panelloom.operators import stats

    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "a double, b double")
    for build in (stats.describe, stats.mean_median):
        out = build(df, ["a", "b"])
        assert "Expand" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 2


def test_histogram(spark):
    v = _values("smooth")
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = {r.bin: r.n for r in quantiles.histogram(df, "x", 30).collect()}
    want = np.histogram(v, bins=30)[0]
    assert [got.get(i, 0) for i in range(30)] == list(want)
    same = spark.createDataFrame([(2.0,)] * 4, "x double")
    assert [(r.bin, r.n) for r in quantiles.histogram(same, "x", 5).collect()] == [(0, 4)]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_rank_equals_sorting(spark, groups):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else rng.choice("bcd"), rng.choice((0.0, 0.0, 1.5, 2.5)), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, s double, id int").repartition(7)
    order = [F.col("s").desc(), F.col("id")]
    got = {r.id: r["rank"] for r in ordering.ranked(df.repartition(3), order, "rank", groups).collect()}
    whole = {r.id: r["rank"] for r in ordering.ranked(df, order, "rank", groups).collect()}
    seen, want = {}, {}
    for g, s, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        k = g if groups else ""
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want and whole == want


def test_top_k_and_tail(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "k string, v double")
    assert [r.k for r in ordering.top_k(df, "v", 2, ["k"]).collect()] == ["b", "c"]
    assert [r.k for r in ordering.top_k(df, "v", 1, ["k"], largest=False).collect()] == ["a"]
    assert [r.k for r in ordering.tail(df, [("k", True)], 2).collect()] == ["d", "c"]
