"""Runs a registered query and its SQL side by side and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(item) for item in value)
    if isinstance(value, dict):
        return tuple(sorted((key, cell(item)) for key, item in value.items()))
    return value


def as_counter(columns, rows):
    order = sorted(range(len(columns)), key=lambda position: columns[position])
    return Counter(tuple(cell(row[position]) for position in order) for row in rows), sorted(columns)


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def compare(spark, connection, folder: str, name: str, run, sql: str | None):
    """(ok, message). Without SQL only the row count is reported."""
    started = time.time()
    frame = run(spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    spent = time.time() - started
    got, got_columns = as_counter(frame.columns, rows)
    if sql is None:
        return True, f"rows only: {len(rows)} in {spent:.2f}s"
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    want, want_columns = as_counter(columns, cursor.fetchall())
    if got_columns != want_columns:
        return False, f"columns differ: {got_columns} / {want_columns}"
    if got != want:
        missing, extra = list((want - got).items())[:3], list((got - want).items())[:3]
        return False, f"{len(rows)} rows / {sum(want.values())}; only in SQL {missing}; only in Spark {extra}"
    return True, f"{len(rows)} rows in {spent:.2f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from fleetsight.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    runs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in runs.items():
        if wanted and not any(part in name for part in wanted):
            continue
        print("..  ", name, flush=True)
        try:
            ok, message = compare(spark, connection, folder, name, run, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, message, flush=True)
    print("bad:", bad)
