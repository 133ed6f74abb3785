"""Rows of Spark and DuckDB in one form."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(data: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return db


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float) or hasattr(v, "__index__"):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_value, r)) for r in frame[columns].itertuples(index=False)), key=repr)
