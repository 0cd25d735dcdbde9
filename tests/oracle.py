"""Run registered queries and compare them with their SQL in an independent engine."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return repr(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(_cell(r[i]) for i in at) for r in rows)


def difference(df, sql: str, folder: str) -> str | None:
    cols, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    want_cols, want = ordered(*sql_rows(sql, folder))
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, e.g. {str(bad[0])[:600]}" if bad else None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from snippetry.session import build_session

    folder = sys.argv[1]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = contract.queries(), contract.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sqls:
                out = difference(df, sqls[name], folder) or "same"
            else:
                out = f"rows {len(df.collect())}"
        except Exception as e:
            out = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name}: {time.time() - began:.1f}s {out}", flush=True)


if __name__ == "__main__":
    main()
