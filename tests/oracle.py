"""Run a query and its SQL side by side and compare them as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from trialspark.bindings import ORACLES, QUERIES
from trialspark.bindings.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, folder: str, name: str) -> str | None:
    """None if query and SQL agree, else a short account of how they differ."""
    df = QUERIES[name](spark, folder)
    con = connect(folder)
    result = con.execute(ORACLES[name])
    columns = [item[0] for item in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours = _rows(df.columns, [tuple(row) for row in df.collect()])
    theirs = _rows(columns, result.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{only_ours.total()} rows only in Spark, {only_theirs.total()} only in SQL; e.g. "
        f"{list(only_ours)[:2]!r:.600} / {list(only_theirs)[:2]!r:.600}"
    )
