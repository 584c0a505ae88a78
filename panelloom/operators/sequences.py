"""Reconstruction error of short runs: a linear autoencoder on the leading subspace of the runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelloom.operators.derive import scale_apply, scale_fit
from panelloom.operators.quantiles import as_struct, quantile_row
from panelloom.operators.windows import sequence_windows
from panelloom.sources.storage import stage
from panelloom.spec import ANOMALY_FEATURES, PanelSpec

LENGTH, LATENT, PERCENTILE = 5, 16, 0.95
STEPS, SEED = 40, 42
FLAT = 1e-10  # a direction with less than this share of the variance is no direction
_Z = "_z_"


def _products(runs: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of the products of the centred columns, added up in the tasks first."""
    width = len(centre)
    rows, columns = (pa.array(x.ravel().astype("int32")) for x in np.indices((width, width)))

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = batch["run"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - centre
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([rows, columns, pa.array(total.ravel())], ["i", "j", "s"])

    parts = runs.select("run").mapInArrow(sums, "i int, j int, s double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # width x width rows
        out[r.i, r.j] = r.s
    return out


def leading_subspace(products: np.ndarray, latent: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """Orthonormal rows that span the leading directions: a fixed number of block power steps.

    The start follows from md5 and every step orthogonalises the rows in turn, so any engine
    that takes the same steps finds the same subspace, with its rows in the same order.
    """
    width = len(products)
    block = np.array([[(int(hashlib.md5(f"{seed}|{k}|{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32 - 0.5
                       for i in range(width)] for k in range(min(latent, width))])
    least = FLAT * np.trace(products)
    for _ in range(steps):
        for k, row in enumerate(block @ products):
            for known in block[:k]:
                row = row - (row @ known) * known
            size = np.sqrt(row @ row)
            block[k] = row / size if size > least else 0.0
    return block


def sequence_error(df: DataFrame, spec: PanelSpec, train: DataFrame | None = None, length: int = LENGTH,
                   latent: int = LATENT, percentile: float = PERCENTILE, features=ANOMALY_FEATURES,
                   steps: int = STEPS) -> DataFrame:
    """Add ``lstm_error`` and ``lstm_anomaly`` to every row.

    Runs stay inside a key. The first rows of a key have no run: error 0 and no
    flag. The cut-off is the percentile of the training errors. Products are
    summed on the executors; only a (length * features)² matrix is returned.
    """
    columns = [c for c in features if c in df.columns]
    training = df if train is None else train
    scaler = stage(scale_fit(training, columns), "scaler")

    def runs(frame):
        scaled = scale_apply(frame.select(spec.key, spec.time, *columns), scaler, columns, _Z)
        made = sequence_windows(scaled, spec, [_Z + c for c in columns], length)
        return made.select(spec.key, spec.time, F.flatten("sequence").alias("run"))

    fitted = stage(runs(training), "runs")
    width = length * len(columns)
    means = fitted.agg(*[F.avg(F.col("run")[i]) for i in range(width)]).first()
    centre = np.array([x or 0.0 for x in means], dtype="float64")  # no runs: every error is 0
    basis = leading_subspace(_products(fitted, centre), latent, steps)
    project = basis.T @ basis

    @F.pandas_udf("double")
    def error(run: pd.Series) -> pd.Series:
        x = np.stack(run.to_numpy()) - centre
        return pd.Series(np.abs(x - x @ project).mean(axis=1))

    scored = fitted.withColumn("lstm_error", error("run")).drop("run")
    scored = stage(scored, "errors")
    bound = as_struct(quantile_row(scored, ["lstm_error"], {"cut": percentile}))
    errors = scored if train is None else runs(df).withColumn("lstm_error", error("run")).drop("run")
    out = df.join(errors, [spec.key, spec.time], "left")
    return (out.withColumn("lstm_error", F.coalesce("lstm_error", F.lit(0.0)))
            .withColumn("lstm_anomaly", F.coalesce(F.col("lstm_error") > bound["lstm_error_cut"], F.lit(False))))
