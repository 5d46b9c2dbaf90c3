"""Run registered queries and their SQL on one folder and compare columns, row counts and values.

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def differences(frame, connection, sql: str) -> list[str]:
    result = connection.execute(sql)
    theirs = table([d[0] for d in result.description], result.fetchall())
    ours = table(frame.columns, frame.collect())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} / {theirs[0]}"]
    if len(ours[1]) != len(theirs[1]):
        return [f"rows {len(ours[1])} / {len(theirs[1])}", repr(ours[1][:2]), repr(theirs[1][:2])]
    return [f"{a} / {b}" for a, b in zip(ours[1], theirs[1]) if repr(a) != repr(b)]


if __name__ == "__main__":
    from catalog.oracle import ORACLE
    from catalog.queries import QUERIES
    from tillwise.session import local_session

    spark = local_session(**{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sys.argv[1])
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        begin = time.time()
        try:
            found = differences(QUERIES[name](spark, sys.argv[1]), connection, ORACLE[name])
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {time.time() - begin:.1f}s", *found[:4], sep="\n    ", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or QUERIES)} differ")
