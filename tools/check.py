"""Run registered queries and compare each with its SQL twin in DuckDB.

usage: python tools/check.py [--sf 0.01] [--jobs 4] [name or inventory id ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor, as_completed

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from chronoweave.plans import load_all  # noqa: E402
from chronoweave.session import local_session  # noqa: E402


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def kind(t: str) -> str:
    t = str(t).lower()
    for names, k in ((("bigint", "long", "hugeint"), "bigint"), (("double",), "double"), (("varchar", "string"), "string"),
                     (("timestamp",), "timestamp"), (("date",), "date"), (("bool",), "bool"), (("int",), "int")):
        if any(t.startswith(n) for n in names):
            return k
    return t


def compare(spark, con, q, sf_dir):
    start = time.time()
    df = q(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    names = sorted(df.columns)
    left = sorted(tuple(cell(row[c]) for c in names) for row in rows)
    if q.sql is None:
        return took, len(rows), "rows-only" if rows else "EMPTY", ""
    cur = con.cursor()
    start = time.time()
    cur.execute(q.sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: kind(d[1]) for d in cur.description}
    out = cur.fetchall()
    sql_took = time.time() - start
    if sorted(cols) != names:
        return took, len(rows), "COLUMNS", f"{names} vs {sorted(cols)}"
    idx = [cols.index(c) for c in names]
    right = sorted(tuple(cell(row[i]) for i in idx) for row in out)
    if len(left) != len(right):
        return took, len(rows), "COUNT", f"{len(left)} vs {len(right)}"
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    diff = {c: (types[c], kinds[c]) for c in names if types[c] != kinds[c] and "array" not in types[c]}
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return took, len(rows), "VALUES", f"{len(bad)} of {len(left)}: {names}\n      {bad[0][0]}\n      {bad[0][1]} {diff}"
    if diff:
        return took, len(rows), "TYPES", str(diff)
    return took, len(rows), "ok" if rows else "EMPTY", f"sql {sql_took:.1f}s" if sql_took > 5 else ""


def main():
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="0.01")
    p.add_argument("--jobs", type=int, default=6)
    a = p.parse_args()
    sf_dir = f"/root/testdata/sf{a.sf}"
    registry = load_all()
    chosen = [q for q in registry.values() if not a.names or q.name in a.names or set(q.covers) & set(a.names)
              or q.build.__module__.rsplit(".", 1)[-1] in a.names]
    spark = local_session("check", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")

    def one(q):
        try:
            return q.name, *compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            text = "".join(traceback.format_exception_only(e))
            return q.name, 0.0, 0, "ERROR", text[:700]

    bad = 0
    with ThreadPoolExecutor(a.jobs) as pool:
        for done in as_completed([pool.submit(one, q) for q in chosen]):
            name, took, n, state, note = done.result()
            good = state in ("ok", "rows-only")
            bad += not good
            print(f"{'  ' if good else '! '}{name:44s} {took:6.1f}s {n:7d} {state} {note}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} good")
    spark.stop()


if __name__ == "__main__":
    main()
