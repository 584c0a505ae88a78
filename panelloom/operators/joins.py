"""Joins between score, code and metric tables. Spark picks the strategy by size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelloom.operators.windows import latest_per_key
from panelloom.spec import PanelSpec


def code_lookup(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct (key, code) pairs."""
    return df.select(spec.key, spec.code).distinct()


def code_join(scores: DataFrame, panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Attach codes; a key with two codes yields two rows."""
    return scores.join(code_lookup(panel, spec), spec.key, "left")


def latest_metric_join(rows: DataFrame, panel: DataFrame, spec: PanelSpec, metric: str) -> DataFrame:
    latest = latest_per_key(panel, spec, [metric]).select(spec.key, metric)
    return rows.join(latest, spec.key, "left")
