"""Run registered queries against their DuckDB oracles (like the driver does).

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v, digits: int | None = None):
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist(), digits)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(names, rows, digits=None):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i], digits) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_names = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(s_rows), "sec": round(t_spark, 2)}
    cur = con.execute(sql)
    d_names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t_spark, 2)}
    if sorted(s_names) != sorted(d_names):
        res["status"] = f"COLUMNS differ: spark={s_names} duck={d_names}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT differs"
        return res
    if rows_of(s_names, s_rows) == rows_of(d_names, d_rows):
        res["status"] = "exact"
    elif rows_of(s_names, s_rows, 9) == rows_of(d_names, d_rows, 9):
        res["status"] = "approx(1e-9)"
    else:
        a, b = rows_of(s_names, s_rows), rows_of(d_names, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["status"] = f"VALUES differ e.g. {diff}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from corefkit.registry import entries
    from corefkit.session import build_session

    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for name, e in sorted(entries().items()):
        if only and name not in only:
            continue
        try:
            r = compare(spark, con, name, e.fn, e.oracle, sf_dir)
        except Exception as ex:  # report and continue
            r = {"name": name, "status": f"ERROR {type(ex).__name__}: {str(ex)[:600]}"}
        ok = r["status"] in ("exact", "rows-only") or r["status"].startswith("approx")
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
