"""Run a registered query and its SQL, and compare the rows regardless of order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return None if value is None else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(_plain(r[n]) for n in order) for r in rows), key=repr)


def mismatch(spark_df, connection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    result = connection.execute(sql)
    sql_columns = [d[0] for d in result.description]
    expected = rows_of(sql_columns, result.fetchall())
    if sorted(spark_df.columns) != sorted(sql_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_columns)}"
    got = rows_of(spark_df.columns, spark_df.collect())
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{str(mine)[:600]} vs {str(theirs)[:600]}"
    return None
