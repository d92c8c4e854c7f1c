"""Runs registered queries next to their SQL. ``python tests/compare.py [folder] [name…]`` prints the outcome."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duckdb_views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None where Spark and SQL agree on columns and rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    short = lambda c: [tuple(x if x is None else x[:60] for x in row) for row in list(c)[:2]]
    return f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {short(got - want)}; only SQL {short(want - got)}"


def main() -> None:
    import __spark_entry__ as entry
    from tutorgauge.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duckdb_views(folder)
    oracle, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                found = difference(run(spark, folder), con, oracle[name])
                note = "ok" if found is None else found
            else:
                note = f"rows {len(run(spark, folder).collect())} (no SQL)"
                found = None
        except Exception as e:  # noqa: BLE001
            found = note = f"{type(e).__name__}: {str(e)[:900]}"
        bad += found is not None
        if found is not None or wanted or name not in oracle:
            print(f"{name:32s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
