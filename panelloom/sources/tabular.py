"""Panel files: CSV in, CSV or Parquet out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from panelloom.functions.exprs import nan_to_null
from panelloom.operators.windows import latest_per_key
from panelloom.sources import storage
from panelloom.sources.storage import stage
from panelloom.spec import INDICATORS, KEY_COUNTRIES, PanelSpec


def known_types(spec: PanelSpec) -> dict:
    numbers = [*spec.passive, *spec.features, *[i.column for i in INDICATORS]]
    return {spec.key: StringType(), spec.code: StringType(), spec.time: IntegerType(),
            **{c: DoubleType() for c in numbers}}


def header_schema(spark: SparkSession, path: str, spec: PanelSpec) -> StructType:
    """Schema from the header line alone: known names typed, all others text."""
    names = spark.read.option("header", True).csv(path, enforceSchema=False).columns
    types = known_types(spec)
    return StructType([StructField(n, types.get(n.strip().lower(), StringType())) for n in names])


def scan_csv(spark: SparkSession, path: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Known columns of a headered CSV; NaN is read as null, other columns are not parsed."""
    schema = header_schema(spark, path, spec)
    rows = normalise_headers(spark.read.schema(schema).option("header", True).csv(path))
    types = known_types(spec)
    def column(name):
        c = F.col(name)
        return nan_to_null(c).alias(name) if isinstance(types[name], DoubleType) else c
    return rows.select(*[column(n) for n in rows.columns if n in types])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column: what any source of a panel must give."""
    kinds = dict(df.dtypes)
    return df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(c)
                       for c in df.columns])


def scan_panel(spark: SparkSession, path: str, kind: str = "parquet", spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A panel in any file format, with NaN as null."""
    return scan_csv(spark, path, spec) if kind == "csv" else without_nan(normalise_headers(spark.read.format(kind).load(path)))


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path))


def export_panel(df: DataFrame, spec: PanelSpec, folder: str, kind: str = "parquet",
                 keys=KEY_COUNTRIES) -> dict[str, str]:
    """Write the full table, each key's latest row, and the key list's rows.

    The input is computed once. The outputs are written aside and then take their places
    together; if one can't be written, the earlier three stay as they were.
    """
    spark = df.sparkSession
    whole = stage(df, "export")
    outputs = {
        "processed": whole,
        "latest_snapshot": latest_per_key(whole, spec).select(*df.columns),
        "key_countries": whole.where(F.col(spec.key).isin(*keys)),
    }
    aside = f"{folder}/.export-{uuid.uuid4().hex}"
    try:
        for name, frame in outputs.items():
            write_table(frame, f"{aside}/new/{name}", kind)
        publish(spark, {f"{aside}/new/{name}": f"{folder}/{name}" for name in outputs}, f"{aside}/old")
    finally:
        storage.remove(spark, aside)
    return {name: f"{folder}/{name}" for name in outputs}


def publish(spark: SparkSession, moves: dict[str, str], aside: str) -> None:
    """Move tables to their places; those that stood there come back if one can't be moved."""
    undo: list[tuple[str, str]] = []
    try:
        for n, (source, target) in enumerate(moves.items()):
            if storage.exists(spark, target):
                storage.move(spark, target, f"{aside}/{n}")
                undo.append((f"{aside}/{n}", target))
            storage.move(spark, source, target)
            undo.append((target, source))
    except Exception:
        for here, there in reversed(undo):
            storage.move(spark, here, there)
        raise
