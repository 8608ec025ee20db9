"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))
    return sorted(cols), out


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return a == b or abs(a - b) <= 1e-9 * max(1, abs(a))
    return type(a) == type(b) and a == b


def compare(spark, con, name, query, sql, sf):
    t0 = time.time()
    df = query(spark, sf)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name}: {len(got)} rows {t1 - t0:.1f}s", len(got) > 0
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    sc, s = rows_of(df.columns, got)
    dc, d = rows_of(dcols, want)
    tail = f"({len(s)} rows, spark {t1 - t0:.1f}s, duck {t2 - t1:.1f}s)"
    if sc != dc:
        return f"FAIL  {name}: columns {sc} vs {dc}", False
    if len(s) != len(d):
        return f"FAIL  {name}: {len(s)} vs {len(d)} rows\n  s={s[:2]}\n  d={d[:2]}", False
    hug = [c for c, ty in dtypes.items() if "HUGEINT" in ty or "DECIMAL" in ty]
    if hug:
        return f"FAIL  {name}: wide types in SQL {hug} {[dtypes[c] for c in hug]}", False
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pair = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(c, st[c], dtypes[c]) for c in st if pair.get(st[c], "?") != dtypes[c]]
    warn = f" types {bad}" if bad else ""
    diff = [(x, y) for x, y in zip(s, d) if not all(close(p, q) for p, q in zip(x, y))]
    exact = sum(1 for x, y in zip(s, d) if x != y)
    if diff:
        return f"FAIL  {name}: {len(diff)} rows differ {tail}{warn}\n  cols={sc}\n  s={diff[0][0]}\n  d={diff[0][1]}", False
    if not s:
        return f"EMPTY {name}{warn}", False
    return f"{'ok   ' if not warn else 'TYPES'} {name} {tail}{'' if not exact else f' inexact {exact}'}{warn}", not warn


def main():
    from rollframe.catalog import load_catalog
    from rollframe.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    cat = load_catalog()
    names = []
    for n in cat.queries:
        if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) or a == "@" + cat.queries[n].__module__.rsplit(".", 1)[-1] for a in args):
            names.append(n)
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    bad = []
    for n in names:
        try:
            line, good = compare(spark, con, n, cat.queries[n], cat.sql.get(n), sf)
        except Exception as e:  # noqa: BLE001
            line, good = f"ERROR {n}: {str(e)[:1500]}", False
        print(line, flush=True)
        if not good:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")


if __name__ == "__main__":
    main()
