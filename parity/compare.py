"""Run a query and its SQL on the same tables and compare every row."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from parity.registry import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty text when the two agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return ""
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    ours, theirs = _bag(df.columns, rows), _bag(columns, found.fetchall())
    if ours == theirs:
        return "" if rows else "no rows"
    extra, lacking = ours - theirs, theirs - ours
    return (
        f"rows {sum(ours.values())} against {sum(theirs.values())}; {sum(extra.values())} differ; "
        f"columns {sorted(columns)}; ours {list(extra)[:2]} theirs {list(lacking)[:2]}"
    )
