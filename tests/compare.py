"""Run registered queries next to their SQL checks: ``python tests/compare.py [dir] [names]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, int):
        return float(f"{v:.10g}") if abs(v) < 2**53 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message) of one query against its check."""
    df = fn(spark, sf_dir)
    rows = df.collect()
    if sql is None:
        return bool(rows), f"{len(rows)} rows, no check"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = bag(df.columns, rows), bag(names, expected)
    if got == want:
        return bool(rows), f"{len(rows)} rows"
    extra, missing = got - want, want - got
    return False, (
        f"{len(rows)} rows against {len(expected)}; {sorted(names)}\n"
        f"   only Spark ({sum(extra.values())}): {list(extra)[:3]}\n"
        f"   only SQL ({sum(missing.values())}): {list(missing)[:3]}"
    )


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from atalaya.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    database = duck(sf)
    checks, bad = entry.oracle_sql(), []
    for key, fn in entry.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = compare(session, database, sf, fn, checks.get(key))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {key:24s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad)
