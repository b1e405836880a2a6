"""Run registered queries against their DuckDB twins.

    python tests/oracle.py [sf_dir] [name ...]
"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(df, con, sql):
    """Empty string when equal, else a short description of the difference."""
    scols, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dcols, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} vs {dcols}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} vs {len(drows)}"
    if not srows:
        return "no rows"
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        per = {}
        for a, b in bad:
            for col, x, y in zip(scols, a, b):
                if x != y:
                    per.setdefault(col, []).append((x, y))
        return f"{len(bad)}/{len(srows)} rows differ: " + "; ".join(
            f"{k} x{len(v)} {v[:2]}" for k, v in list(per.items())[:6])
    types = dict(df.dtypes)
    empty = [col for i, col in enumerate(scols) if all(row[i] is None for row in srows)]
    return f"ALL-NULL columns {empty}" if empty else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.session import spark_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = spark_session()
    con = connect(sf)
    sql, fns = entry.oracle_sql(), entry.queries()
    names = [n for n in fns if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    fails = 0
    for n in names:
        t = time.time()
        try:
            df = fns[n](spark, sf)
            if n in sql:
                msg = compare(df, con, sql[n])
            else:
                msg = f"(no twin, {len(df.collect())} rows)"
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        ok = msg == "" or msg.startswith("(no twin")
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(names)} queries, {fails} failures")
    spark.stop()
