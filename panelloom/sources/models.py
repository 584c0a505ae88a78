"""Fitted isolation models as Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from panelloom.operators.isolation import IsolationModel


def save_model(model: IsolationModel, path: str) -> None:
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    model.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    model.cutoff.write.mode("overwrite").parquet(f"{path}/cutoff")
    names = [(i, c) for i, c in enumerate(model.features)]
    spark.createDataFrame(names, "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> IsolationModel:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()  # one row per feature
    return IsolationModel(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/scaler"),
                          spark.read.parquet(f"{path}/cutoff"), tuple(r["feature"] for r in rows))
