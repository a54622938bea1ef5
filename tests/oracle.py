"""Compare registered queries with their SQL: ``python -m tests.oracle DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from workload.inputs import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(columns, cursor.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"row {a} != {b}"
    return None if ours else "no rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from galeledger.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in queries().items():
        if names and name not in names or name not in oracle_sql():
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, query, oracle_sql()[name])
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    sys.exit(bad > 0)
