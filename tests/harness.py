"""Spark-vs-DuckDB compare, shaped like the driver's check: row count,
column names, and an order-insensitive comparison of normalised values.

CLI: ``python -m tests.harness [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


_SPARK_T = {"bigint": "i64", "int": "i32", "smallint": "i16", "tinyint": "i8", "double": "f64", "float": "f32",
            "string": "str", "boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts", "date": "date"}
_DUCK_T = {"BIGINT": "i64", "INTEGER": "i32", "SMALLINT": "i16", "TINYINT": "i8", "DOUBLE": "f64", "FLOAT": "f32",
           "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date"}


def _norm_type(t: str, table: dict) -> str:
    t = str(t)
    if t.lower().startswith("decimal"):
        return t.lower().replace(" ", "")
    return table.get(t, table.get(t.upper(), t))


def spark_rows(df):
    cols = df.columns
    types = {f.name: _norm_type(f.dataType.simpleString(), _SPARK_T) for f in df.schema.fields}
    return cols, [tuple(r) for r in df.collect()], types


def duck_rows(con, sql):
    rel = con.sql(sql)
    types = {n: _norm_type(t, _DUCK_T) for n, t in zip(rel.columns, rel.types)}
    return list(rel.columns), rel.fetchall(), types


def compare(scols, srows, dcols, drows):
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    a, b = _rows(scols, srows), _rows(dcols, drows)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return False, f"first diff (cols {sorted(scols)}):\n spark={x}\n duck ={y}"
    return True, f"{len(srows)} rows"


def check(spark, name, sf_dir, con=None):
    from tidemark.plans.registry import load_all
    q = load_all()[name]
    t0 = time.time()
    scols, srows, stypes = spark_rows(q.build(spark, sf_dir))
    t1 = time.time()
    if q.oracle is None:
        return None, f"rows-only: {len(srows)} rows ({t1 - t0:.1f}s)"
    con = con or duck(sf_dir)
    dcols, drows, dtypes = duck_rows(con, q.oracle)
    ok, msg = compare(scols, srows, dcols, drows)
    tdiff = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes) if stypes.get(c) != dtypes.get(c)}
    if ok and tdiff:
        ok, msg = False, f"column types differ (spark, duck): {tdiff}"
    return ok, f"{msg} (spark {t1 - t0:.1f}s, duck {time.time() - t1:.1f}s)"


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    from tidemark.plans.registry import load_all
    from tidemark.session import local_session
    spark = local_session()
    names = argv or sorted(load_all())
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = check(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print(f"{'OK  ' if ok else ('ROWS' if ok is None else 'FAIL')} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} not failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
