"""Compare registered queries with their SQL on one scale factor.

    python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from metaloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(canon(x)) for x in v) + "]"
    return str(v)


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(canon(r[i]) for i in order) for r in rows), key=lambda t: tuple("\0" if x is None else x for x in t)
    )


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def oracle_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows={len(rows)} (no oracle)", True
    cols, expected = oracle_rows(con, sql)
    got_c, got = canon_rows(df.columns, rows)
    exp_c, exp = canon_rows(cols, expected)
    if got_c != exp_c:
        return f"columns {got_c} != {exp_c}", False
    if got != exp:
        diff = [(a, b) for a, b in zip(got, exp) if a != b][:2]
        return f"rows {len(got)} vs {len(exp)}; first differences {str(diff)[:600]}", False
    return f"rows={len(got)}", True


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    from metaloom.plans import catalog

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = []
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            message, ok = compare(spark, con, sf_dir, fn, catalog.ORACLE.get(name))
        except Exception as exc:
            message, ok = "ERROR " + str(exc)[:500], False
            if len(wanted) == 1:
                traceback.print_exc()
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - began:.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
