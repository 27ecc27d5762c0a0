"""Runs registered queries against their SQL form and prints what differs.

    python tests/check_queries.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def compare(spark, con, name: str, sf: str) -> tuple[str, float]:
    start = time.time()
    df = contract.queries()[name](spark, sf)
    plan = plan_of(df)
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "DIFFERENT from the rule that no rows are crossed", 0.0
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}", seconds
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"DIFFERENT columns {got_columns} / {want_columns}", seconds
    if len(got) != len(want):
        return f"DIFFERENT row counts {len(got)} / {len(want)}", seconds
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"DIFFERENT {len(bad)} of {len(got)} rows, first {str(bad[0][0])[:300]} / {str(bad[0][1])[:300]}", seconds
    types = [type(v) for v in got[0]] if got else []
    odd = [c for c, a, b in zip(got_columns, types, got and want[0] or []) if a is not type(b)]
    return f"equal, {len(got)} rows" + (f" TYPES {odd}" if odd else ""), seconds


def main() -> None:
    from crowdread.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("check"), connect(sf)
    for name in contract.queries():
        if len(sys.argv) > 2 and not any(part in name for part in sys.argv[2:]):
            continue
        try:
            verdict, seconds = compare(spark, con, name, sf)
        except Exception as error:  # one failing query must not hide the others
            verdict, seconds = f"FAILED {type(error).__name__}: {str(error)[:400]}", 0.0
        print(f"{name:34s} {seconds:6.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
