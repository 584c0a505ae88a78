"""Query registry: a name, a Spark function and, where possible, its SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.operators import derive
from panelloom.plans import fixtures
from panelloom.plans.oracle import START
from panelloom.sources.storage import reused
from panelloom.spec import PanelSpec

SPEC = PanelSpec(span=8)  # several chunks a key, so that the queries cross their borders
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Keys of the fixture that the list and single-key reports use.
KEY = "NATION_7"
KEYS = ("NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_7", "NATION_8",
        "NATION_10", "NATION_11", "NATION_13", "NATION_17", "NATION_19", "NATION_21")
SQL_KEYS = ", ".join(f"'{k}'" for k in KEYS)


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def show(df: DataFrame, plain, rounded=(), digits: int = 7) -> DataFrame:
    return df.select(*plain, *[F.round(c, digits).alias(c) for c in rounded])


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Panel of the fixture, written once for each state of the tables."""
    return reused(spark, "panel", fixtures.panel_paths(sf), lambda: fixtures.panel(spark, sf))


def features(spark: SparkSession, sf: str, start: int = START) -> DataFrame:
    """Feature table of the fixture, written once for each state of the tables."""
    return reused(spark, f"features-{start}", fixtures.panel_paths(sf), lambda: derive.pipeline(panel(spark, sf), SPEC, start))
