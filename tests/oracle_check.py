"""Runs named queries on Spark and their SQL on DuckDB and compares schema names, rows and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = []
    for row in frame[columns].itertuples(index=False, name=None):
        rows.append(tuple("" if pd.isna(value) else f"{type(value).__name__[:3]}{value}" for value in row))
    return sorted(rows)


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame.copy()
    for name in out.columns:
        values = out[name]
        if pd.api.types.is_bool_dtype(values):
            out[name] = values.map(str)
        elif pd.api.types.is_numeric_dtype(values):
            out[name] = values.map(lambda v: None if pd.isna(v) else repr(float(v)))
        elif pd.api.types.is_datetime64_any_dtype(values):
            out[name] = values.map(lambda v: None if pd.isna(v) else pd.Timestamp(v).isoformat())
        else:
            out[name] = values.map(
                lambda v: None if v is None or v is pd.NaT else v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)
            )
    for name in out.columns:
        # Dates come back as objects from one side and as times from the other.
        out[name] = out[name].map(lambda v: v[:10] if isinstance(v, str) and v.endswith("T00:00:00") else v)
    return out


def compare(spark, connection, name, query, sql, sf_dir) -> str | None:
    """None when both sides agree, else what differs."""
    got, expected = query(spark, sf_dir).toPandas(), connection.execute(sql).df()
    if sorted(got.columns) != sorted(expected.columns):
        return f"{name}: columns {sorted(got.columns)} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{name}: {len(got)} rows != {len(expected)}"
    left, right = canonical(normalized(got)), canonical(normalized(expected))
    for a, b in zip(left, right):
        if a != b:
            return f"{name}: {a} != {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from stridelake.session import build_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for name, query in entry_points.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            result = compare(spark, connection, name, query, entry_points.oracle_sql()[name], sf_dir)
        except Exception as error:  # report and go on with the other queries
            result = f"{name}: {type(error).__name__} {str(error)[:600]}"
        print(f"{time.time() - start:6.1f}s", "ok  " + name if result is None else "BAD " + result, flush=True)
