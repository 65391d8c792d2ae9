"""Run registered queries on Spark and their oracle SQL on DuckDB; compare."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (str, bytes)) and pd.isna(v)):
            return None
    except (TypeError, ValueError):
        pass
    return v if isinstance(v, (str, int, bool)) else str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark_pdf, duck_pdf):
    c1, r1 = rows_of(spark_pdf)
    c2, r2 = rows_of(duck_pdf)
    if c1 != c2:
        return False, f"columns differ: {c1} vs {c2}"
    if len(r1) != len(r2):
        return False, f"row count {len(r1)} vs {len(r2)}"
    diff = [(a, b) for a, b in zip(r1, r2) if a != b]
    if diff:
        return False, f"{len(diff)} rows differ, e.g. {diff[0]}"
    return True, f"{len(r1)} rows"


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from secscan.session import build_session
    spark = build_session(app="oracle-check")
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sp = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ors:
            print(f"ROWS {name}: {len(sp)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            dk = duck(ors[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        ok, msg = compare(sp, dk)
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} spark {t1 - t0:.1f}s")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    sys.exit(1 if main(set(args) or None, sf) else 0)
