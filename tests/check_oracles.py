"""Compare registered queries with their SQL: python tests/check_oracles.py [sf] [name prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def canonical(rows):
    return sorted((tuple(repr(v) for v in r) for r in rows))


def compare(spark, sf_dir, fn, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = canonical(df.select(*[f"`{n}`" for n in names]).collect())
    types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    if sql is None:
        return f"rows only {len(got)}" if got else "EMPTY"
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(theirs) != names:
        return f"COLUMNS {sorted(theirs)} != {names}"
    want = canonical(con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql}) q").fetchall())
    if theirs != types:
        return f"TYPES { {n: (types[n], theirs[n]) for n in names if types[n] != theirs[n]} }"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"VALUES {names} rows {len(got)}/{len(want)} spark {extra} sql {missing}"
    return f"ok {len(got)}" if got else "EMPTY"


def main():
    from venuelens.session import build_session
    from __spark_entry__ import oracle_sql, queries
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = oracle_sql(), []
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            out = compare(spark, f"/root/testdata/sf{sf}", fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            out = "ERROR " + str(e)[:600]
        if not out.startswith(("ok", "rows only")):
            bad.append(name)
        print(f"{name}: {out[:900]} [{time.time() - t:.1f}s]", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
