"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelloom.spec import GRADES, SCORE_SEVERITY, SEVERITY_ORDER

INF = float("inf")


def clip(x: Column, low, high) -> Column:
    """Clamp to [low, high]; a null stays null (least/greatest would skip it)."""
    bounded = F.least(F.greatest(x, _col(low)), _col(high))
    return F.when(x.isNotNull(), bounded)


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def finite(x: Column) -> Column:
    """Null for NaN and for both infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def to_number(name: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast(`{name}` AS {kind})")


def is_sovereign(code: str) -> Column:
    return F.length(F.col(code)) == 3


def _ladder(x: Column, steps, position: int) -> Column:
    """Nested CASE over (lower bound, values...) rows, best first."""
    out = None
    for step in steps:
        value = F.lit(step[position])
        if step[0] is None:
            return out.otherwise(value)
        out = F.when(x >= step[0], value) if out is None else out.when(x >= step[0], value)
    return out


def grade(score: Column) -> Column:
    return _ladder(score, GRADES, 1)


def label(score: Column) -> Column:
    return _ladder(score, GRADES, 2)


def score_band(score: Column) -> Column:
    """Lower and upper end of the gauge band the score falls in."""
    edges = [g[0] for g in GRADES if g[0] is not None]
    tops = [100.0] + edges
    rows = [(edge, f"{edge:.0f}-{top:.0f}") for edge, top in zip(edges, tops)]
    return _ladder(score, rows + [(None, f"0-{edges[-1]:.0f}")], 1)


def score_severity(score: Column) -> Column:
    out = None
    for bound, name in SCORE_SEVERITY:
        out = F.when(score < bound, name) if out is None else out.when(score < bound, name)
    return out.otherwise("normal")


def zscore_severity(z: Column, threshold: float) -> Column:
    size = F.abs(z)
    return (F.when(size > threshold * 2.0, "critical")
            .when(size > threshold * 1.5, "high")
            .when(size > threshold, "medium")
            .otherwise("normal"))


def severity_rank(severity: Column) -> Column:
    """0 for the most severe; unknown names come last."""
    out = None
    for rank, name in enumerate(SEVERITY_ORDER):
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out.otherwise(len(SEVERITY_ORDER))


def money_round(x: Column, scale: int) -> Column:
    """Round a value built from already rounded numbers, in decimal."""
    return F.round(x.cast(f"decimal(28,{scale + 8})"), scale).cast("double")


def title_case(name: str) -> str:
    return name.replace("_", " ").title()


def unit_hash(*parts: Column) -> Column:
    """Uniform number in [0, 1) from a row's identity, the same on every retry."""
    bits = F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))
    return bits.cast("double") / F.lit(float(1 << 52))
