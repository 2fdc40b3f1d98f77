"""Run registered queries against their DuckDB oracle and compare.

Usage:  python tests/oracle_harness.py [sf_dir] [name ...]

Comparison: column names (sorted), row count, then the multiset of rows with
values normalised (floats compared exactly after repr, NaN as NULL).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT", "array<string>": "VARCHAR[]",
                 "array<bigint>": "BIGINT[]"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_names = df.columns
    if len(set(n.lower() for n in s_names)) < len(s_names):
        return {"name": name, "status": f"COLUMNS repeat: {s_names}"}
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    d_names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res["oracle_rows"] = len(d_rows)
    d_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in df.schema.fields}
    tdiff = {k: (s_types.get(k), d_types.get(k)) for k in s_types
             if k in d_types and s_types[k] != d_types[k]}
    if tdiff:
        res["types"] = tdiff
    res["oracle_sec"] = round(time.time() - t1, 2)
    if sorted(s_names) != sorted(d_names):
        res["status"] = f"COLUMNS differ: spark={sorted(s_names)} oracle={sorted(d_names)}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT differs"
        return res
    a, b = rows_of(s_names, s_rows), rows_of(d_names, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES differ, e.g. {diff}"
        return res
    res["status"] = "ok"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from stockfair.session import get_session

    spark = get_session(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    missing = [n for n in sqls if n not in qs]
    if missing:
        print("oracle without query:", missing)
    print(f"{bad} failing of {len(qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
