"""Runs registered queries against their DuckDB statements: ``python tests/compare.py DIR [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def normal(columns, rows):
    """Rows with columns in name order, as a sorted list of texts."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def difference(spark, db, name: str, folder: str) -> str | None:
    """None if both sides return the same columns and rows, else a short account."""
    df = queries()[name](spark, folder)
    ours = [tuple(row) for row in df.collect()]
    result = db.execute(oracle_sql()[name])
    theirs_columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {df.columns} against {theirs_columns}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    left, right = normal(df.columns, ours), normal(theirs_columns, theirs)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference:\n  {a[:300]}\n  {b[:300]}"
    return None


def main() -> None:
    from lexigrain.storage import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = local_session(cores="8", **{"spark.ui.showConsoleProgress": "false"})
    db = connect(folder)
    failed = []
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, db, name, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {'ok' if problem is None else problem}  {time.time() - started:.1f}s", flush=True)
        if problem is not None:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} equal; differing: {failed}")


if __name__ == "__main__":
    main()
