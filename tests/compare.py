"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder: str, name: str, run, sql: str | None) -> tuple[str, int, float]:
    """``(problem or '', rows, seconds)`` of one query."""
    start = time.time()
    df = run(spark, folder)
    got = canonical(df.columns, df.collect())
    seconds = time.time() - start
    if sql is None:
        return "", len(got[1]), seconds
    cur = con.execute(sql)
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), seconds
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1]), seconds
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} differing rows, first {str(bad[0])[:600]}", len(got[1]), seconds
    return "", len(got[1]), seconds


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tidewater.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            problem, rows, seconds = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:700]}", 0, 0.0
        failed += bool(problem)
        kind = "sql" if name in sqls else "rows only"
        print(f"{'FAIL' if problem else 'ok  '} {name:24s} {rows:7d} rows {seconds:6.2f}s {kind} {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
