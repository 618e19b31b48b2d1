"""Run registered queries in Spark and their SQL in DuckDB and compare all values.

``python tests/compare.py [sf_dir] [name ...]`` checks from the command line.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the given tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return str(value)


def rows_of(columns, rows):
    """Rows as sorted tuples with the columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def check(spark, con, sf_dir, name, fn, sql):
    """Return (seconds, row count, problem or None)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return took, len(got), None if got else "no rows"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return took, len(got), f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return took, len(got), f"rows {len(got)} != {len(want)}; only spark {extra}; only sql {lack}"
    if not got:
        return took, 0, "no rows"
    types = {repr({type(v).__name__ for v in col}) for col in zip(*got)}
    wtypes = {repr({type(v).__name__ for v in col}) for col in zip(*want)}
    return took, len(got), None if types == wtypes else f"types {types} != {wtypes}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from treeloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        try:
            took, n, problem = check(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            took, n, problem = 0, 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {n:7d} rows {took:6.2f}s {'' if name in sqls else '(no sql)'}{problem or ''}"[:1500], flush=True)
    print("bad:", bad)
