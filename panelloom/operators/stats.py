"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions.exprs import money_round
from panelloom.operators.filters import latest_year_filter
from panelloom.operators.quantiles import as_struct, quantile_row
from panelloom.operators.windows import latest_per_key
from panelloom.spec import SOURCE_COLUMNS, PanelSpec


def annual_total(df: DataFrame, spec: PanelSpec, target: str = "co2") -> DataFrame:
    return df.groupBy(spec.time).agg(F.coalesce(F.sum(target), F.lit(0.0)).alias(target))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of the total per value; most frequent first. The total is that of the groups."""
    groups = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("n").alias("n")).scalar()
    return groups.withColumn("share", F.col("n") / total).orderBy(F.col("n").desc(), column)


def alert_counts(df: DataFrame) -> DataFrame:
    def flagged(name: str) -> Column:
        return F.count_if(F.col("is_anomaly") & (F.col("severity") == name)).alias(name)
    return df.agg(flagged("critical"), flagged("high"), flagged("medium"),
                  F.count_if("is_anomaly").alias("total"))


def _beside(df: DataFrame, columns: list[str], moments: dict, probs: dict[str, float]) -> DataFrame:
    """(column, moments..., quantiles...): one wide aggregate, and the quantiles' own, turned into rows at the end."""
    x = {c: F.col(c).cast("double") for c in columns}
    one = df.agg(*[build(x[c]).alias(f"{c}|{name}") for c in columns for name, build in moments.items()])
    one = one.withColumn("_q", as_struct(quantile_row(df, columns, probs)))
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{m}`").alias(m) for m in moments],
                      *[F.col(f"_q.{c}_{q}").alias(q) for q in probs]) for c in columns]
    return one.select(F.inline(F.array(*cells)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max), rounded to 3."""
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = _beside(df, columns, moments, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return found.select("column", "count", *[F.round(c, 3).alias(c) for c in
                                             ("mean", "std", "min", "q25", "q50", "q75", "max")])


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return (shares.unpivot([], columns, "column", "share")
            .orderBy(F.col("share").desc(), "column"))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every ordered pair; one pass over the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs],
                 *[F.count(a).alias(f"{a}|{a}") for a in columns])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
             for a, b in pairs for x, y in ((a, b), (b, a))]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"),
                       F.when(F.col(f"`{c}|{c}`") > 1, 1.0).alias("corr")) for c in columns]
    return one.select(F.inline(F.array(*cells)))


def distinct_count(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.agg(F.count_distinct(spec.key).alias("keys"), F.count(F.lit(1)).alias("rows"),
                  F.min(spec.time).alias("first_year"), F.max(spec.time).alias("last_year"))


def mean_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, median) with an exact distributed median."""
    return _beside(df, columns, {"mean": F.avg}, {"median": 0.5})


def global_kpis(scored: DataFrame, spec: PanelSpec, score: str = "sustainability_score") -> DataFrame:
    """One row of score statistics over each key's latest row."""
    latest = latest_per_key(scored, spec, [score])
    s, k = F.col(score), F.col(spec.key)
    median = as_struct(quantile_row(latest, [score], {"median": 0.5}))
    # Smallest key among the best, smallest key among the worst.
    top = F.min(F.struct((-s).alias("s"), k)).alias("_top")
    bottom = F.min(F.struct(s.alias("s"), k)).alias("_bottom")
    one = latest.agg(F.avg(s.cast("decimal(10,2)")).alias("_avg"),
                     F.count_if(s >= 80).alias("countries_excellent"),
                     F.count_if(s < 35).alias("countries_critical"), top, bottom)
    return one.select(
        F.round("_avg", 1).cast("double").alias("global_avg_score"),
        money_round(median[f"{score}_median"], 1).alias("global_median_score"),
        "countries_excellent", "countries_critical",
        F.col("_top")[spec.key].alias("top_country"),
        F.col("_bottom")[spec.key].alias("bottom_country"),
        money_round(-F.col("_top.s"), 1).alias("top_score"),
        money_round(F.col("_bottom.s"), 1).alias("bottom_score"))


def error_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Mean absolute error and R²; sums of squares come from one pass."""
    y, p = F.col(actual), F.col(predicted)
    both = df.where(y.isNotNull() & p.isNotNull())
    grouped = both.groupBy(*by) if by else both.groupBy()
    return (grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"),
                        F.sum((y - p) * (y - p)).alias("_rss"),
                        (F.var_pop(y) * F.count(F.lit(1))).alias("_tss"))
            .withColumn("r2", 1 - F.try_divide(F.col("_rss"), F.col("_tss"))).drop("_rss", "_tss"))


def anomaly_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("is_anomaly").alias("flagged"), F.count(F.lit(1)).alias("rows"),
                  F.avg(F.col("is_anomaly").cast("int")).alias("rate"))


def source_breakdown(df: DataFrame, spec: PanelSpec, columns=SOURCE_COLUMNS) -> DataFrame:
    """(key, source, amount) of the last period, complete rows only."""
    last = latest_year_filter(df, spec).na.drop(how="any", subset=list(columns))
    return last.unpivot([spec.key], list(columns), "source", "amount")
