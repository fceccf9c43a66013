"""Run registered queries against their SQL in DuckDB: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata")


def canon(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(canon(i) for i in x)
    if isinstance(x, dict):
        return tuple(sorted((k, canon(i)) for k, i in x.items()))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for f in (DATA / sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def compare(df, con, name: str) -> tuple[bool, str]:
    t = time.time()
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows-only {len(got)} rows {spent:.1f}s"
    cur = con.execute(sql)
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return False, f"columns {cols} vs {ocols}"
    if got != want:
        gs, ws = set(got), set(want)
        return False, f"{len(got)} vs {len(want)} rows; only spark {list(gs - ws)[:2]}; only sql {list(ws - gs)[:2]}"
    return True, f"{len(got)} rows {spent:.1f}s"


def main() -> int:
    from findmill.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("sf") else "sf0.01"
    names = [a for a in args if not a.startswith("sf")] or list(entry.queries())
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names:
        try:
            ok, note = compare(entry.queries()[name](spark, str(DATA / sf)), con, name)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
