"""Compare every registered query with its SQL oracle, strictly: types, rows and values.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def compare(df, con, text: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    got_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    cursor = con.execute(text)
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    order = [d[0] for d in cursor.description]
    if sorted(order) != names:
        return f"columns: spark {names} sql {sorted(order)}"
    wrong = {n: (got_types[n], want_types[n]) for n in names if got_types[n] != want_types[n]}
    if wrong:
        return f"types (spark, sql): {wrong}"
    got = [tuple(_key(row[n]) for n in names) for row in df.collect()]
    at = [order.index(n) for n in names]
    want = [tuple(_key(row[i]) for i in at) for row in want]
    if len(got) != len(want):
        return f"rows: spark {len(got)} sql {len(want)}"
    left, right = sorted(got), sorted(want)
    if left != right:
        extra = sorted(set(left) - set(right))[:2]
        missing = sorted(set(right) - set(left))[:2]
        return f"values of {names}: spark only {extra} sql only {missing}"
    return None


def main(argv: list[str]) -> int:
    from curbflow.session import build_session
    from curbflow.workload.trips import drop_layers

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in argv[1:] or sorted(queries):
        began = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(frame, con, oracles[name])
                verdict = "ok" if problem is None else f"DIFF {problem[:1500]}"
            else:
                rows = frame.collect()
                verdict = f"rows={len(rows)}" + ("" if rows else " EMPTY")
                problem = None if rows else "empty"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = verdict = f"ERROR {type(error).__name__}: {str(error)[:3000]}"
        failures += problem is not None
        print(f"{name:28s} {time.time() - began:6.2f}s {verdict}", flush=True)
    drop_layers(spark)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
