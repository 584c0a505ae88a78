"""Arrow batches of bounded size, for rows that are long."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """The frame, after the session's Arrow batches are held to `size` bytes: texts and images are long, and a
    batch is in memory several times. Only memory depends on it."""
    session = df.sparkSession
    held = _bytes(session.conf.get(SETTING))
    if held > size or held <= 0:  # zero or less: no bound
        session.conf.set(SETTING, str(size))
    return df


def _bytes(size: str) -> int:
    """A size as Spark's settings state it: a number with or without a binary unit."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")
