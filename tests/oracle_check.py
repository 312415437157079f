"""Comparison of a Spark result with DuckDB on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def canonical_rows(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows as a sorted bag."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    cut = [tuple(_canonical(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cut, key=repr)


def compare(spark_df, con, sql: str) -> tuple[list, list]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = canonical_rows(names, cursor.fetchall())
    actual = canonical_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    return actual, expected
