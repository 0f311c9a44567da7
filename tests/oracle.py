"""Run registered queries against their SQL in DuckDB and compare the values.

    python tests/oracle.py [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return str(int(r)) if r == int(r) else repr(r)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        only_got, only_want = sorted(a - b)[:2], sorted(b - a)[:2]
        return (f"rows {len(got)} vs {len(want)}; differing {len(a - b)}/{len(b - a)}\n    spark  "
                + "\n           ".join(s[:600] for s in only_got) + "\n    oracle "
                + "\n           ".join(s[:600] for s in only_want))
    return None


def main():
    import __spark_entry__ as entry
    from gradeloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, build, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - a report over many queries
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += diff is not None
        kind = "" if name in oracle else " (no oracle)"
        print(f"{'ok  ' if diff is None else 'FAIL'} {name}{kind} {time.time() - t:.1f}s"
              + (f"\n    {diff}" if diff else ""), flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
