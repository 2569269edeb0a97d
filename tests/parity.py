"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver.

Usage: python tests/parity.py [sf_dir] [query-name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


_SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT"}


def spark_types(df):
    return {f.name: _SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}


def duck_types(con, sql):
    rel = con.sql(sql)
    return {c: str(t) for c, t in zip(rel.columns, rel.types)}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    st, dt = spark_types(df), duck_types(con, sql)
    ok_types = st == dt
    ok = ok_cols and ok_types and len(s_rows) == len(d_rows) and hs == hd
    print(f"{'OK ' if ok else 'BAD'} {name:34s} rows {len(s_rows):>7} / {len(d_rows):>7} "
          f"spark {t1 - t0:6.2f}s duck {t2 - t1:6.2f}s", flush=True)
    if not ok:
        if not ok_cols:
            print("   columns spark:", s_cols, "\n   columns duck: ", d_cols)
        if not ok_types:
            print("   types differ:", {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt)
                                       if st.get(c) != dt.get(c)})
        only_s = sorted(set(ls) - set(ld))[:5]
        only_d = sorted(set(ld) - set(ls))[:5]
        print("   cols:", sorted(s_cols))
        for x in only_s:
            print("   spark only:", x)
        for x in only_d:
            print("   duck only: ", x)
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from revcurve.plans.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        if name not in sqls:
            df = fn(spark, sf_dir)
            print(f"--  {name:34s} rows {df.count():>7} (no oracle)")
            continue
        try:
            if not compare(spark, con, name, fn, sqls[name], sf_dir):
                bad.append(name)
        except Exception as e:  # report and continue
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:400]}")
            bad.append(name)
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
