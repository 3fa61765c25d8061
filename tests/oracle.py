"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{file}/*.parquet" if file.is_dir() else file
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(picked, key=repr)


def _kind(name: str) -> str:
    name = name.lower()
    return {"varchar": "string", "integer": "int"}.get(name, name)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between the two results, at most a few lines."""
    cursor = con.execute(sql)
    their_types = {d[0]: _kind(str(d[1])) for d in cursor.description}
    theirs = _rows(list(their_types), cursor.fetchall())
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} against {theirs[0]}"]
    out = []
    our_types = dict(spark_df.dtypes)
    for c in ours[0]:
        if our_types[c] != their_types[c]:
            out.append(f"type of {c}: {our_types[c]} against {their_types[c]}")
    if len(ours[1]) != len(theirs[1]):
        out.append(f"{len(ours[1])} rows against {len(theirs[1])}")
    for a, b in zip(ours[1], theirs[1], strict=False):
        if a != b and not all(_same(x, y) for x, y in zip(a, b, strict=True)):
            out.append(f"{a} against {b}")
    return out[:6]


def _same(x, y) -> bool:
    both_nan = isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)
    return x == y or both_nan
