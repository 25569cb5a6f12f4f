"""Run registered queries in Spark and in DuckDB and compare the bags of rows.

    python -m tests.compare [--sf 0.01] [name-prefix …]
"""

import argparse
import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = bag(df.columns, df.collect())
    if sql is None:
        return None, len(got), 0
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = bag(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} sql {sorted(names)}", len(got), len(want)
    if got != want:
        gs, ws = set(got), set(want)
        extra = [r for r in got if r not in ws][:3]
        missing = [r for r in want if r not in gs][:3]
        return f"rows: spark-only {extra} sql-only {missing}", len(got), len(want)
    return None, len(got), len(want)


def main():
    from netlens.plans import load
    from tests.session import make_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    queries, oracles = load()
    spark = make_session()
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name == n or name.startswith(n + "_") for n in args.names):
            continue
        t = time.time()
        try:
            err, n, m = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - a report line per query
            err, n, m = f"{type(e).__name__}: {str(e)[:700]}", -1, -1
        bad += err is not None
        kind = "rows-only" if name not in oracles else "oracle"
        print(f"{'FAIL' if err else 'ok':4} {name:42} {n:>7} {m:>7} {time.time()-t:5.1f}s {kind} {err or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
