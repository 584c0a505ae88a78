"""Row filters and column selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.functions.exprs import is_sovereign, to_number
from panelloom.operators.quantiles import as_struct
from panelloom.spec import REPORT_METRICS, PanelSpec


def sovereign_filter(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.where(is_sovereign(spec.code))


def year_filter(df: DataFrame, spec: PanelSpec, start: int = 1990) -> DataFrame:
    return df.where(F.col(spec.time) >= start)


def year_range(df: DataFrame, spec: PanelSpec, low: int | None = None,
               high: int | None = None, floor: int = 2000) -> DataFrame:
    """Inclusive range; the default low end is max(first year, floor)."""
    t = F.col(spec.time)
    if low is None:
        first = as_struct(df.agg(F.min(spec.time).alias("first")))
        df = df.where(t >= F.greatest(first["first"], F.lit(floor)))
    else:
        df = df.where(t >= low)
    return df if high is None else df.where(t <= high)


def prune_columns(df: DataFrame, spec: PanelSpec) -> DataFrame:
    wanted = [spec.key, spec.code, spec.time, *spec.passive, *spec.features]
    return df.select(*[c for c in wanted if c in df.columns])


def drop_all_null(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.na.drop(how="all", subset=spec.present(df.columns))


def drop_any_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=columns)


def key_filter(df: DataFrame, spec: PanelSpec, key: str) -> DataFrame:
    return df.where(F.col(spec.key) == key).orderBy(spec.time)


def key_in_list(df: DataFrame, spec: PanelSpec, keys) -> DataFrame:
    return df.where(F.col(spec.key).isin(*keys))


def key_in_table(df: DataFrame, spec: PanelSpec, keys: DataFrame) -> DataFrame:
    """Membership in a key table; Spark broadcasts it only if it is small."""
    return df.join(keys.select(spec.key), spec.key, "left_semi")


def coerce_numeric(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: to_number(c, kind) for c in columns})


def flag_label(df: DataFrame) -> DataFrame:
    """Anomaly/Normal text and a positive marker size from the score."""
    return df.withColumns({
        "anomaly_label": F.when(F.col("is_anomaly"), "Anomaly").otherwise("Normal"),
        "size_val": F.greatest(-F.col("if_score"), F.lit(0.01)),
    })


def key_domain(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.select(spec.key).distinct().orderBy(spec.key)


def time_domain(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.agg(F.min(spec.time).alias("first"), F.max(spec.time).alias("last"))


def latest_year_filter(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows of the table-wide last period; the maximum is a scalar subquery."""
    last = df.agg(F.max(spec.time).alias("last")).scalar()
    return df.where(F.col(spec.time) == last)


def metric_column(df: DataFrame, metric: str, fallback: str | None = None) -> str:
    """A whitelisted metric the frame has, or the fallback."""
    allowed = set(REPORT_METRICS) | ({fallback} if fallback else set())
    if metric in allowed and metric in df.columns:
        return metric
    if fallback is not None and fallback in df.columns:
        return fallback
    raise ValueError(f"metric {metric!r} is not available")
