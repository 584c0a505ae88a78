"""Exact quantiles and histograms that never gather a column in one task.

Order statistics are found by radix descent on the order-preserving form of a double: its
sign and exponent, then its mantissa as an integer. A pass counts the rows of each digit
below the known prefix, for all columns and probabilities at once, and keeps the digits that
hold a wanted rank. When the rows with a prefix are equal, or at most `FEW`, they are read off.
So a pass holds a fixed number of cells, and no list grows with the table. The descent is at
most `PASSES` passes; each starts when the frame is built, as a model is fitted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelloom.functions.exprs import finite

FEW = 4_096     # rows of a range that are read off
DIGIT_BITS = 12
WHOLE_BITS = 54  # a mantissa of 53 bits as a signed integer; the logarithm may miss the exponent by one
PASSES = 2 + -(-WHOLE_BITS // DIGIT_BITS)
_ABOVE = 1_100  # makes all exponents positive


@dataclass
class _Range:
    """Rows of a column between two values that hold wanted ranks."""

    column: str
    exponent: int          # floor of the logarithm; of no meaning for zero
    bits: int              # bits of the mantissa that are not known yet
    low: float
    high: float
    n: int
    below: int             # rows of the column below the range
    ranks: list[int] = field(default_factory=list)


def _power(exponent: int) -> list[float]:
    """Two powers of two whose product scales by 2^exponent; a step through either loses no bit."""
    half = exponent // 2
    return [math.ldexp(1.0, half), math.ldexp(1.0, exponent - half)]


def _first_digit(x: Column) -> Column:
    """Sign and exponent, in the order of the values."""
    exponent = F.floor(F.log2(F.abs(x))).cast("int") + _ABOVE
    return F.when(x == 0, 0).when(x > 0, exponent).otherwise(-exponent)


def _next_digit(x: Column, part: _Range) -> Column:
    """The leading unknown bits of the mantissa, and all above them, in the order of the values."""
    one, two = _power(WHOLE_BITS - 2 - part.exponent)
    return F.shiftright((x * F.lit(one) * F.lit(two)).cast("bigint"), max(0, part.bits - DIGIT_BITS))


def _counted(rows: DataFrame, cells: list[Column]) -> DataFrame:
    """(part, digit, n, low, high, until, total): one row for each digit; `until` counts the rows up to it."""
    each = rows.select(F.inline(F.array_compact(F.array(*cells))))
    counts = each.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    digits = Window.partitionBy("part")  # at most 2^DIGIT_BITS rows, or as many as there are exponents
    return counts.withColumns({"until": F.sum("n").over(digits.orderBy("digit")), "total": F.sum("n").over(digits)})


def _cell(part: int, x: Column, digit: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), digit.cast("bigint").alias("digit"), x.alias("x"))


def _ranks(p: float, n: int) -> tuple[float, int, int]:
    rank = p * (n - 1)
    return rank, math.floor(rank), math.ceil(rank)


def _first_pass(rows: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict[str, int], list[_Range]]:
    cells = [F.when(F.col(c).isNotNull(), _cell(i, F.col(c), _first_digit(F.col(c)))) for i, c in enumerate(columns)]
    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def inside(rank):
        return (rank >= F.col("until") - F.col("n")) & (rank < F.col("until"))

    def holds(p):
        rank = p * (F.col("total") - 1)
        return inside(F.floor(rank)) | inside(F.ceil(rank))

    found = _counted(rows, cells).where(F.exists(wanted, holds)).collect()  # at most two rows a probability and column
    sizes, ranges = {columns[r.part]: r.total for r in found}, []
    for r in found:
        known = {k for p in probs for k in _ranks(p, r.total)[1:] if r.until - r.n <= k < r.until}
        ranges.append(_Range(columns[r.part], abs(r.digit) - _ABOVE, WHOLE_BITS, r.low, r.high, r.n, r.until - r.n, sorted(known)))
    return sizes, ranges


def _next_pass(rows: DataFrame, ranges: list[_Range]) -> list[_Range]:
    cells, wanted = [], None
    for i, part in enumerate(ranges):
        x = F.col(part.column)
        cells.append(F.when(x.between(part.low, part.high), _cell(i, x, _next_digit(x, part))))
        mine = F.array(*[F.lit(k - part.below) for k in part.ranks])
        wanted = F.when(F.col("part") == i, mine) if wanted is None else wanted.when(F.col("part") == i, mine)
    holds = F.exists(wanted, lambda k: (k >= F.col("until") - F.col("n")) & (k < F.col("until")))
    out = []
    for r in _counted(rows, cells).where(holds).collect():  # at most one row a rank
        part = ranges[r.part]
        below = part.below + r.until - r.n
        ranks = [k for k in part.ranks if below <= k < below + r.n]
        out.append(_Range(part.column, part.exponent, max(0, part.bits - DIGIT_BITS), r.low, r.high, r.n, below, ranks))
    return out


def _read_off(rows: DataFrame, ranges: list[_Range]) -> list[list[float]]:
    """The sorted values of ranges with few rows."""
    lists = [F.collect_list(F.when(F.col(p.column).between(p.low, p.high), F.col(p.column))).alias(f"v{i}") for i, p in enumerate(ranges)]
    return [sorted(values) for values in rows.agg(*lists).first()] if ranges else []


def order_statistics(df: DataFrame, columns: list[str], probs: list[float], few: int = FEW,
                     log: list | None = None) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """(rows of each column, value of each (column, rank)) for the ranks next to the probabilities.

    `log` receives (ranges, rows of the largest list) of each pass.
    """
    rows = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    values: dict[tuple[str, int], float] = {}
    sizes, ranges = _first_pass(rows, columns, probs)
    short: list[_Range] = []
    while True:
        open_ones = []
        for part in ranges:
            if part.low == part.high:
                values.update({(part.column, k): part.low for k in part.ranks})
            elif part.n <= few:
                short.append(part)
            else:
                open_ones.append(part)
        if log is not None:
            log.append((len(ranges), 0))
        if not open_ones:
            break
        ranges = _next_pass(rows, open_ones)
    for part, found in zip(short, _read_off(rows, short)):
        values.update({(part.column, k): found[k - part.below] for k in part.ranks})
        if log is not None:
            log.append((len(short), len(found)))
    return sizes, values


def _exact(df: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict[str, int], dict[tuple[str, float], float]]:
    """Linear interpolation between neighbours, in the built-in function's order of operations."""
    columns = list(dict.fromkeys(columns))
    sizes, values = order_statistics(df, columns, probs)
    out = {}
    for c, n in sizes.items():
        for p in probs:
            rank, down, up = _ranks(float(p), n)
            low, high = values[c, down], values[c, up]
            out[c, p] = low if low == high else (up - rank) * low + (rank - down) * high
    return sizes, out


def _constants(spark: SparkSession, cells: list[Column]) -> DataFrame:
    """One row of constants, which the optimiser puts in place of a scalar subquery."""
    return spark.sql("SELECT 1 AS one").select(*cells)


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, value, n): linear-interpolated quantiles of finite values; columns without one have no rows."""
    sizes, found = _exact(df, columns, probs)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.lit(found.get((c, p))).cast("double").alias("value"),
                      F.lit(sizes.get(c, 0)).cast("bigint").alias("n")) for c in columns for p in probs]
    return _constants(df.sparkSession, [F.inline(F.array(*cells))]).where("n > 0")


def quantile_row(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """One row: ``<column>_<name>`` per column and named probability."""
    _, found = _exact(df, columns, list(probs.values()))
    return _constants(df.sparkSession, [F.lit(found.get((c, p))).cast("double").alias(f"{c}_{name}")
                                        for c in columns for name, p in probs.items()])


def as_struct(one_row: DataFrame) -> Column:
    """Scalar subquery over a one-row frame: fitted parameters without a join."""
    return one_row.select(F.struct(*one_row.columns).alias("_params")).scalar()


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal-width counts over [min, max], last bin closed."""
    return histograms(df, [column], bins).drop("column")


def histograms(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(column, bin, low, high, n) of the finite values of each column, in one pass after that for the ends."""
    rows = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    ends = rows.agg(*[a for c in columns for a in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))])

    def place(c):
        low, high = F.col(f"_p.low_{c}"), F.col(f"_p.high_{c}")
        at = F.floor(F.try_divide(F.col(c) - low, (high - low) / bins))
        return F.when(F.col(c).isNotNull(), F.when(at.isNull(), 0).otherwise(F.least(at, F.lit(bins - 1)))).cast("bigint")

    placed = rows.withColumn("_p", as_struct(ends))
    one = placed.select("_p", *[place(c).alias(c) for c in columns]).agg(
        F.first("_p").alias("_p"), *[F.count_if(F.col(c) == b).alias(f"{c}|{b}") for c in columns for b in range(bins)])
    cells = []
    for c in columns:
        low, width = F.col(f"_p.low_{c}"), (F.col(f"_p.high_{c}") - F.col(f"_p.low_{c}")) / bins
        cells += [F.struct(F.lit(c).alias("column"), F.lit(b).cast("bigint").alias("bin"), (low + b * width).alias("low"),
                           (low + (b + 1) * width).alias("high"), F.col(f"`{c}|{b}`").alias("n")) for b in range(bins)]
    return one.select(F.inline(F.array(*cells))).where("n > 0")


def trim(df: DataFrame, column: str, low: float | None, high: float, closed: bool = True) -> DataFrame:
    """Rows inside the quantile bounds: [low, high] if closed, else below high."""
    probs = {"high": high} if low is None else {"low": low, "high": high}
    bounds = as_struct(quantile_row(df, [column], probs))
    x = F.col(column)
    upper = x <= bounds[f"{column}_high"] if closed else x < bounds[f"{column}_high"]
    kept = df.where(finite(x.cast("double")).isNotNull() & upper)
    return kept if low is None else kept.where(x >= bounds[f"{column}_low"])
