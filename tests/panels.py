"""Small panels for the tests."""

import random

from panelloom.spec import PanelSpec

SPEC = PanelSpec(features=("co2", "coal_co2", "oil_co2", "gas_co2"))
COLUMNS = "country string, iso_code string, year int, population double, gdp double, " \
          "co2 double, coal_co2 double, oil_co2 double, gas_co2 double"


def panel_rows(seed=7):
    """One key with most of the rows, short keys, gaps, nulls, and negative periods."""
    rng = random.Random(seed)
    rows = []
    for key, code, periods in (("hot", "HOT", range(-40, 60)), ("two", "TWO", (3, 50)), ("one", "ONE", (11,)),
                               ("gap", "GAP", (0, 1, 2, 17, 18, 40, 41)), ("void", "VOI", range(5, 15)),
                               ("area", "AREA", range(0, 9)), ("none", None, range(0, 4))):
        for t in periods:
            if key == "hot" and rng.random() < 0.15:
                continue
            value = lambda p: None if key == "void" or rng.random() < p else round(rng.uniform(-5, 100), 3)
            rows.append((key, code, t, 10.0, value(0.2), value(0.3), value(0.4), value(0.4), value(0.4)))
    return rows


def panel(spark):
    return spark.createDataFrame(panel_rows(), COLUMNS).repartition(5)


def collected(df, digits=9):
    """Rows as a sorted list, doubles rounded."""
    def value(v):
        if isinstance(v, float):
            return round(v, digits) + 0.0
        return [value(x) for x in v] if isinstance(v, list) else v
    rows = [tuple(value(v) for v in r) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))
