"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows.

``python -m tests.oracle /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return ("null",)
    if isinstance(value, float) and math.isnan(value):
        return ("null",)
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return ("b", bool(value))
    try:
        return ("n", round(float(value), 6) + 0.0)
    except (TypeError, ValueError):
        return ("s", str(value))


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in ordered.itertuples(index=False, name=None))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows against {len(sql_frame)}"
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    if left == right:
        return None
    different = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(different)} rows differ, first {different[0]}"


def type_notes(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    kinds = lambda f: {c: f[c].dtype.kind for c in f.columns}
    a, b = kinds(spark_frame), kinds(sql_frame)
    return [f"{c}: {a[c]} against {b[c]}" for c in a if c in b and a[c] != b[c]]


def main() -> None:
    from __spark_entry__ import _registered
    from slatewise.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, connection, failed = build_session("oracle"), connect(sys.argv[1]), 0
    for name, entry in _registered().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            ours = entry.run(spark, folder).toPandas()
            spent = time.time() - start
            if entry.sql is None:
                print(f"rows  {name} {len(ours)} {spent:.1f}s", flush=True)
                continue
            theirs = connection.execute(entry.sql).df()
            problem = compare(ours, theirs)
            notes = type_notes(ours, theirs)
            print(f"{'ok   ' if problem is None else 'FAIL '} {name} {len(ours)} {spent:.1f}s sql {time.time() - start - spent:.1f}s {problem or ''} {notes or ''}", flush=True)
            failed += problem is not None
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name} {str(error)[:1500]}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
