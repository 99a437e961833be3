"""Runs a registered query and its DuckDB counterpart on the same tables."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sf_dir.iterdir():
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (float, Decimal)):
        return round(float(value), 5)
    if isinstance(value, (bool, int)):
        return float(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, query, sql, sf="sf0.001"):
    df = query(spark, os.fspath(DATA / sf))
    made = connect(DATA / sf).execute(sql)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of([d[0] for d in made.description], made.fetchall())
