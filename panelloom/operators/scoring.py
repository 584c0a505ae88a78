"""Composite 0-100 scores: fitted bounds, norms, trend bonus, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions.exprs import clip, grade, label, score_band
from panelloom.operators import chunks
from panelloom.operators.ordering import ranked
from panelloom.operators.quantiles import as_struct, histogram, quantile_row
from panelloom.operators.stats import global_kpis, value_counts
from panelloom.operators.windows import latest_per_key
from panelloom.spec import (
    EMPTY_SCORE, INDICATORS, PILLARS, TREND_CLAMP, TREND_FACTOR, Indicator, PanelSpec, Pillar)

SCORE = "sustainability_score"
BOUNDS = {"low": 0.01, "high": 0.99}


def fit_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact 1 % and 99 % quantile of every column."""
    return quantile_row(df, columns, BOUNDS)


def indicator_columns(df: DataFrame, indicators: tuple[Indicator, ...] = INDICATORS) -> list[str]:
    return [i.column for i in indicators if i.column in df.columns]


def indicator_fit(df: DataFrame, indicators: tuple[Indicator, ...] = INDICATORS) -> DataFrame:
    return fit_bounds(df, indicator_columns(df, indicators))


def _norm(x: Column, low: Column, high: Column, lower_is_better: bool) -> Column:
    share = clip(F.try_divide(x - low, high - low), 0.0, 1.0)
    return F.lit(1.0) - share if lower_is_better else share


def indicator_norm(df: DataFrame, bounds: DataFrame,
                   indicators: tuple[Indicator, ...] = INDICATORS, prefix: str = "norm_") -> DataFrame:
    """One ``norm_<column>`` per present indicator: 0.5 if it has no usable range."""
    fitted = set(bounds.columns)
    p = F.col("_bounds")
    rows = df.withColumn("_bounds", as_struct(bounds))
    out = {}
    for i in indicators:
        if i.column not in df.columns:
            continue
        x = F.col(i.column).cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        if f"{i.column}_low" not in fitted:
            out[prefix + i.column] = F.when(known, F.lit(0.5))
            continue
        low, high = p[f"{i.column}_low"], p[f"{i.column}_high"]
        norm = _norm(x, low, high, i.lower_is_better)
        usable = low.isNotNull() & (high != low)
        out[prefix + i.column] = F.when(known, F.when(usable, norm).otherwise(F.lit(0.5)))
    return rows.withColumns(out).drop("_bounds")


def _weights(indicators: tuple[Indicator, ...]) -> dict[str, float]:
    total = sum(i.weight for i in indicators)
    return {i.column: i.weight / total for i in indicators}


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def base_score(df: DataFrame, bounds: DataFrame, indicators: tuple[Indicator, ...] = INDICATORS,
               breakdown: bool = True) -> DataFrame:
    """Weighted mean of the non-null norms × 100, with a per-indicator breakdown."""
    present = [i for i in indicators if i.column in df.columns]
    rows = indicator_norm(df, bounds, indicators)
    if not present:
        return rows.withColumn(SCORE, F.lit(EMPTY_SCORE))
    weight = _weights(indicators)
    norms = {i.column: F.col(f"norm_{i.column}") for i in present}
    gained = _sum([F.coalesce(norms[c] * weight[c], F.lit(0.0)) for c in norms])
    possible = _sum([F.when(norms[c].isNotNull(), weight[c]).otherwise(0.0) for c in norms])
    score = F.round(F.coalesce(F.try_divide(gained, possible) * 100, F.lit(EMPTY_SCORE)), 2)
    out = rows.withColumn(SCORE, score)
    if breakdown:
        out = out.withColumns({f"score_{i.name}": F.round(norms[i.column] * 100, 2) for i in present})
    return out.drop(*[f"norm_{c}" for c in norms])


def breakdown_map(df: DataFrame, indicators: tuple[Indicator, ...] = INDICATORS) -> DataFrame:
    """The per-indicator columns of ``base_score`` as one map, nulls left out."""
    names = [i.name for i in indicators if f"score_{i.name}" in df.columns]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                              F.array(*[F.col(f"`score_{n}`") for n in names]))
    return (df.withColumn("breakdown", F.map_filter(pairs, lambda _, v: v.isNotNull()))
            .drop(*[f"score_{n}" for n in names]))


def trend_bonus(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add 0.3 of the clamped change since the previous row; decimal arithmetic."""
    score = F.col(SCORE).cast("decimal(10,2)")
    def change(w):
        return F.coalesce(score - F.lag(score).over(w), F.lit(0).cast("decimal(10,2)"))
    moved = chunks.over_history(df, spec, 1, {"_change": change})
    clamp = F.least(F.greatest(F.col("_change"), F.lit(-TREND_CLAMP)), F.lit(TREND_CLAMP))
    total = score + clamp * F.lit(TREND_FACTOR).cast("decimal(2,1)")
    bounded = F.least(F.greatest(total, F.lit(0)), F.lit(100))
    return moved.withColumns({
        "score_yoy_change": F.col("_change").cast("double"),
        SCORE: F.round(bounded, 2).cast("double")}).drop("_change")


def score_panel(df: DataFrame, spec: PanelSpec, bounds: DataFrame | None = None,
                indicators: tuple[Indicator, ...] = INDICATORS, breakdown: bool = True) -> DataFrame:
    """(key, time, score, change, breakdown...) of every row."""
    fitted = bounds if bounds is not None else indicator_fit(df, indicators)
    columns = [spec.key, spec.time, *indicator_columns(df, indicators)]
    scored = base_score(df.select(*columns), fitted, indicators, breakdown)
    return trend_bonus(scored.drop(*indicator_columns(df, indicators)), spec)


def leaderboard(scored: DataFrame, spec: PanelSpec, year: int | None = None) -> DataFrame:
    """Rank of each key by its latest score, or by its score in one period."""
    columns = [spec.key, spec.time, SCORE]
    if year is None:
        rows = latest_per_key(scored, spec, [SCORE])
    else:
        rows = scored.where(F.col(spec.time) == year)
    placed = ranked(rows.select(*columns), [F.col(SCORE).desc(), F.col(spec.key)])
    s = F.col(SCORE)
    return placed.select("rank", *columns, grade(s).alias("grade"), label(s).alias("label"))


# --- pillars -------------------------------------------------------------

def pillar_columns(df: DataFrame, pillars: tuple[Pillar, ...] = PILLARS) -> list[str]:
    return [c for p in pillars for c in p.columns if c in df.columns]


def pillar_fit(df: DataFrame, pillars: tuple[Pillar, ...] = PILLARS) -> DataFrame:
    return fit_bounds(df, pillar_columns(df, pillars))


def pillar_score(df: DataFrame, spec: PanelSpec, bounds: DataFrame,
                 pillars: tuple[Pillar, ...] = PILLARS) -> DataFrame:
    """Per pillar the mean of its non-null norms × 100, and the weighted total."""
    fitted = set(bounds.columns)
    p = F.col("_bounds")
    rows = df.withColumn("_bounds", as_struct(bounds))
    scores = {}
    for pillar in pillars:
        norms = []
        for c in (c for c in pillar.columns if c in df.columns):
            x = F.col(c).cast("double")
            low, high = (p[f"{c}_low"], p[f"{c}_high"]) if f"{c}_low" in fitted else (F.lit(0.0), F.lit(1.0))
            low, high = F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))
            width = F.when(high == low, F.lit(1.0)).otherwise(high - low)
            share = clip((x - low) / width, 0.0, 1.0)
            norms.append(F.lit(1.0) - share if pillar.lower_is_better else share)
        if not norms:
            scores[pillar.name] = F.lit(EMPTY_SCORE)
            continue
        total = _sum([F.coalesce(n, F.lit(0.0)) for n in norms])
        known = _sum([F.when(n.isNotNull(), 1.0).otherwise(0.0) for n in norms])
        scores[pillar.name] = F.coalesce(F.try_divide(total, known) * 100, F.lit(EMPTY_SCORE))
    named = rows.select(spec.key, spec.time, *[v.alias(f"_p_{k}") for k, v in scores.items()])
    total = _sum([F.col(f"`_p_{q.name}`") * q.weight for q in pillars])
    return named.select(spec.key, spec.time, F.round(total, 2).alias("composite_score"),
                        *[F.round(F.col(f"`_p_{q.name}`"), 2).alias(f"pillar_{q.name}") for q in pillars])


# --- reports on scores ---------------------------------------------------

def score_vs_average(scored: DataFrame, spec: PanelSpec, key: str) -> DataFrame:
    """One key's latest score against the average; 50 if the key has no rows."""
    kpi = as_struct(global_kpis(scored, spec))
    mine = (scored.where(F.col(spec.key) == key)
            .agg(F.max_by(F.col(SCORE), F.col(spec.time)).alias("_score")))
    s = F.col("score")
    return (mine.select(F.lit(key).alias(spec.key), F.coalesce("_score", F.lit(EMPTY_SCORE)).alias("score"),
                        kpi["global_avg_score"].alias("global_avg_score"))
            .withColumns({"difference": F.round(s.cast("decimal(10,2)") - F.col("global_avg_score").cast("decimal(10,2)"), 2).cast("double"),
                          "grade": grade(s), "label": label(s), "band": score_band(s)}))


def grade_distribution(board: DataFrame) -> DataFrame:
    return value_counts(board, "grade")


def score_histogram(board: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(board, SCORE, bins)


def score_trend(scored: DataFrame, spec: PanelSpec, keys) -> DataFrame:
    return scored.where(F.col(spec.key).isin(*keys)).select(spec.key, spec.time, SCORE)
