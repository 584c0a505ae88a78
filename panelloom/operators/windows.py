"""Per-key window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.functions.exprs import zscore_severity
from panelloom.operators import chunks
from panelloom.spec import PanelSpec


def rolling_zscore(df: DataFrame, spec: PanelSpec, column: str = "co2", window: int = 5,
                   threshold: float = 2.5) -> DataFrame:
    """(x - rolling mean) / rolling sample deviation, at least two known values."""
    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        x = F.col(column)
        std = F.stddev_samp(x).over(frame)
        z = (x - F.avg(x).over(frame)) / F.when(std == 0, F.lit(1e-9)).otherwise(std)
        return F.when(F.count(x).over(frame) >= 2, z)
    out = chunks.over_history(df, spec, window - 1, {"zscore": build})
    z = F.col("zscore")
    return out.withColumns({
        "zscore_anomaly": F.coalesce(F.abs(z) > threshold, F.lit(False)),
        "zscore_severity": zscore_severity(z, threshold)})


def detect_key_series(df: DataFrame, spec: PanelSpec, column: str = "co2", window: int = 5,
                      threshold: float = 2.5, min_rows: int = 3) -> DataFrame:
    """Rolling z-score for every key with enough rows; needs the value column."""
    if column not in df.columns:
        return df
    return rolling_zscore(enough_history(df, spec, min_rows), spec, column, window, threshold)


def enough_history(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    return chunks.key_totals(df, spec).where(F.col("_rows") >= n).drop("_rows")


def latest_per_key(df: DataFrame, spec: PanelSpec, columns: list[str] | None = None) -> DataFrame:
    """Row of each key's last period; each map task sends one row a key."""
    keep = [c for c in (columns or df.columns) if c not in (spec.key, spec.time)]
    return chunks.last_rows(df.select(spec.key, spec.time, *keep), spec, 1).drop("_rev")


def score_diff(df: DataFrame, spec: PanelSpec, column: str = "sustainability_score",
               name: str = "score_yoy_change") -> DataFrame:
    """Change from the previous row, 0 on a key's first row."""
    return chunks.over_history(df, spec, 1, {
        name: lambda w: F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0.0))})


def sequence_windows(df: DataFrame, spec: PanelSpec, columns: list[str], length: int = 5,
                     name: str = "sequence") -> DataFrame:
    """Every run of ``length`` consecutive rows of a key as an array of arrays."""
    step = F.array(*[F.col(c) for c in columns])
    out = chunks.over_history(df, spec, length - 1, {
        name: lambda w: F.collect_list(step).over(w.rowsBetween(-(length - 1), 0))})
    return out.where(F.size(name) == length)


def tail_stats(df: DataFrame, spec: PanelSpec, target: str = "co2", n: int = 5) -> DataFrame:
    """Per key: last period and value, mean of the last n values, mean of the last n differences."""
    rows = chunks.last_rows(df.where(F.col(target).isNotNull()).select(spec.key, spec.time, target),
                            spec, n + 1)
    value, rev = F.col(target), F.col("_rev")
    newest = F.max(F.when(rev == 1, value))
    return (rows.groupBy(spec.key)
            .agg(F.max(spec.time).cast("int").alias("last_year"), newest.alias("last_value"),
                 F.avg(F.when(rev <= n, value)).alias("recent_mean"),
                 F.try_divide(newest - F.max_by(value, rev), (F.max(rev) - 1).cast("double"))
                 .alias("recent_trend")))


def timeseries_folds(df: DataFrame, spec: PanelSpec, folds: int = 3) -> DataFrame:
    """Expanding-window split per key: (fold, role) rows.

    With n rows the test blocks are the last ``folds`` blocks of n // (folds + 1)
    rows, and fold i trains on everything before its block.
    """
    rows = chunks.positions(df, spec)
    test = F.floor(F.col("_rows") / (folds + 1))
    numbers = F.explode(F.array(*[F.lit(i) for i in range(1, folds + 1)])).alias("fold")
    split = rows.select(*rows.columns, numbers)
    start = F.col("_rows") - (folds - F.col("fold") + 1) * test
    role = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + test, "test")
    return split.withColumn("role", role).where(F.col("role").isNotNull()).drop("_pos", "_rows")
