"""Run a registered query and its SQL side by side and compare all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    return str(v) if v is not None else None


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple("" if x is None else "\0" + x for x in t)), sorted(names)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, statement: str) -> list[str]:
    """Differences in names, types or rows; an empty list means equal."""
    relation = con.sql(statement)
    problems = []
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if ours != theirs:
        problems.append(f"schema {ours} / {theirs}")
    mine, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    other, other_names = _rows(relation.columns, relation.fetchall())
    if names != other_names:
        return problems + [f"columns {names} / {other_names}"]
    if len(mine) != len(other):
        problems.append(f"rows {len(mine)} / {len(other)}")
    different = [(a, b) for a, b in zip(mine, other) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems
