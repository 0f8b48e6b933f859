"""Comparing a Spark result with DuckDB rows, without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from gaugework.suite.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(row[i]) for i in order] for row in rows), key=repr)


def differences(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    result = connection.execute(sql)
    names = [item[0] for item in result.description]
    expected = _sorted_rows(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    actual = _sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}: {actual[:3]} / {expected[:3]}"
    for left, right in zip(actual, expected):
        if left != right:
            return f"{left} != {right}"
    return None
