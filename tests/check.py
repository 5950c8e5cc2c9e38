"""Compare registered queries with their SQL: python tests/check.py [sf] [name ...]; CHECK_GROUP_ROWS=n splits larger keys"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr), sorted(columns)


def compare(spark, con, name, fn, sql, sf_dir):
    """None if equal, else a text that says what differs."""
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    want, wc = rows_of([c[0] for c in res.description], res.fetchall())
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} sql {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[:2]} {gc}"
    return None if got else "EMPTY (both)"


if __name__ == "__main__":
    import __spark_entry__ as e
    from alertsieve.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    if os.environ.get("CHECK_GROUP_ROWS"):  # force the paths for keys that are too large for one task
        spark.conf.set("spark.alertsieve.maxGroupRows", os.environ["CHECK_GROUP_ROWS"])
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/sf{sf}"
    con = duck(d)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if names and not any(name.startswith(n.rstrip("*")) if n.endswith("*") else name == n for n in names):
            continue
        t = time.time()
        try:
            msg = compare(spark, con, name, fn, sqls.get(name), d)
        except Exception as x:  # report and go on
            msg = f"{type(x).__name__}: {str(x)[:600]}"
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {time.time() - t:6.2f}s {'sql ' if name in sqls else 'rows'} {name} {msg or ''}", flush=True)
    print("bad:", bad)
