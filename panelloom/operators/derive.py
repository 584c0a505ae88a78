"""Derived features, lag features and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from panelloom.functions.exprs import clip, finite
from panelloom.operators import chunks
from panelloom.operators.chunks import CHUNK, with_chunk
from panelloom.operators.quantiles import as_struct
from panelloom.operators.repair import fill, select_rows
from panelloom.sources.storage import stage
from panelloom.spec import PanelSpec

TINY = 1e-9
FOSSIL = ("coal_co2", "oil_co2", "gas_co2")
LAGS = (1, 2, 3, 5)


def yoy(c: str):
    """Percent change from the previous row; 0 where it is undefined."""
    def build(w) -> Column:
        before = F.lag(c).over(w)
        return F.coalesce(finite(F.try_divide(F.col(c) - before, before) * 100), F.lit(0.0))
    return build


def rolling_mean(c: str, size: int):
    return lambda w: F.avg(c).over(w.rowsBetween(-(size - 1), 0))


def fossil_ratio(columns: list[str]) -> Column:
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in FOSSIL if c in columns]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return clip(F.try_divide(total, F.col("co2") + TINY), 0.0, 1.0)


def ratio_columns(df: DataFrame) -> DataFrame:
    """Row-wise ratios, each only where its inputs exist."""
    columns = df.columns
    if "co2" in columns and any(c in columns for c in FOSSIL):
        df = df.withColumn("fossil_ratio", fossil_ratio(columns))
    if "fossil_ratio" in df.columns:
        df = df.withColumn("renewable_proxy", F.lit(1.0) - F.col("fossil_ratio"))
    if "co2" in columns and "gdp" in columns:
        df = df.withColumn("co2_intensity", F.try_divide(F.col("co2"), F.col("gdp") + TINY))
    return df


def yoy_change(df: DataFrame, spec: PanelSpec, column: str = "co2") -> DataFrame:
    return chunks.over_history(df, spec, 1, {f"{column}_yoy_change": yoy(column)})


def rolling5(df: DataFrame, spec: PanelSpec, column: str = "co2", size: int = 5) -> DataFrame:
    return chunks.over_history(df, spec, size - 1, {f"{column}_rolling{size}": rolling_mean(column, size)})


def features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """All derived columns; the change and the mean share one window sort."""
    if "co2" in df.columns:
        df = chunks.over_history(df, spec, 4, {
            "co2_yoy_change": yoy("co2"), "co2_rolling5": rolling_mean("co2", 5)})
    return ratio_columns(df)


def pipeline(df: DataFrame, spec: PanelSpec, start: int = 1990) -> DataFrame:
    """Filter, fill and derive.

    The selected rows are written once, so the source is read once; whole rows are
    exchanged on (key, chunk) for the fills and stay there for the features.
    """
    rows = stage(with_chunk(select_rows(df, spec, start), spec), "selected")
    filled = fill(rows, spec, spec.present(rows.columns), zero=True)
    return features(filled, spec).drop(CHUNK)


# --- normalisation -------------------------------------------------------

def scale_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    skip = {spec.time, *spec.passive}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in skip]


def minmax_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's least and greatest value."""
    return df.agg(*[F.min(c).alias(f"{c}_min") for c in columns],
                  *[F.max(c).alias(f"{c}_max") for c in columns])


def minmax_apply(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0 and nulls stay null."""
    p = F.col("_params")
    rows = df.withColumn("_params", as_struct(fitted))
    def scaled(c):
        low, width = p[f"{c}_min"], p[f"{c}_max"] - p[f"{c}_min"]
        return (F.col(c) - low) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    return rows.withColumns({c: scaled(c) for c in columns}).drop("_params")


def minmax_normalise(df: DataFrame, spec: PanelSpec) -> DataFrame:
    columns = scale_columns(df, spec)
    return minmax_apply(df, minmax_fit(df, columns), columns)


def scale_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population deviation; nulls count as 0."""
    x = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    return df.agg(*[F.avg(x[c]).alias(f"{c}_mean") for c in columns],
                  *[F.stddev_pop(x[c]).alias(f"{c}_std") for c in columns])


def scale_apply(df: DataFrame, fitted: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    p = F.col("_params")
    rows = df.withColumn("_params", as_struct(fitted))
    def scaled(c):
        std = p[f"{c}_std"]
        return (F.coalesce(F.col(c), F.lit(0.0)) - p[f"{c}_mean"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return rows.withColumns({prefix + c: scaled(c) for c in columns}).drop("_params")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return scale_apply(df, scale_fit(df, columns), columns)


# --- lag features --------------------------------------------------------

def lag_names(target: str) -> list[str]:
    return [*[f"{target}_lag{n}" for n in LAGS], f"{target}_diff1",
            f"{target}_rolling3", f"{target}_rolling5"]


def lag_features(df: DataFrame, spec: PanelSpec, target: str = "co2", leaky: bool = True,
                 required: list[str] | None = None) -> DataFrame:
    """Lags, first difference and rolling means of the target.

    ``leaky`` includes the current value in the difference and the means; without
    it they use earlier rows only, as a forecast must. Rows with a null in
    ``required`` (default: any column) are dropped.
    """
    shift = 0 if leaky else 1
    def lagged(n):
        return lambda w: F.lag(target, n).over(w)
    def mean(size):
        return lambda w: F.avg(target).over(w.rowsBetween(-(size - 1 + shift), -shift))
    def diff(w):
        newer = F.lag(target, shift).over(w) if shift else F.col(target)
        return newer - F.lag(target, 1 + shift).over(w)
    columns = {f"{target}_lag{n}": lagged(n) for n in LAGS}
    columns[f"{target}_diff1"] = diff
    columns[f"{target}_rolling3"] = mean(3)
    columns[f"{target}_rolling5"] = mean(5)
    out = chunks.over_history(df, spec, max(LAGS) + shift, columns)
    return out.na.drop(how="any", subset=required)
