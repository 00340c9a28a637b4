"""Local replica of the correctness gate: Spark query vs DuckDB SQL on parquet.

Usage: python tests/oracle_harness.py [sf_dir] [query-name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_digest(df: pd.DataFrame) -> tuple[list[str], int, str]:
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(x) for x in r)) for r in df[cols].itertuples(index=False, name=None))
    return cols, len(rows), hashlib.md5("\n".join(rows).encode()).hexdigest()


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    pdf = sdf.toPandas()
    t1 = time.time()
    out = {"query": name, "spark_rows": len(pdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["oracle"] = "none"
        return out
    con = con or duck(sf_dir)
    odf = con.sql(sql).df()
    out["oracle_sec"] = round(time.time() - t1, 2)
    sc, sn, sh = frame_digest(pdf)
    oc, on, oh = frame_digest(odf)
    out.update(cols_match=sc == oc, rows_match=sn == on, hash_match=sh == oh, oracle_rows=on)
    if sc != oc:
        out["spark_cols"], out["oracle_cols"] = sc, oc
    return out


def main(argv):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from equipoise.session import make_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    spark = make_session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, sf_dir, name, fn, sqls.get(name), con)
        except Exception as e:  # noqa: BLE001
            r = {"query": name, "error": repr(e)[:600]}
        ok = r.get("hash_match", r.get("oracle") == "none" and "error" not in r)
        bad += 0 if ok else 1
        print(("OK   " if ok else "FAIL ") + repr(r), flush=True)
    print(f"failures: {bad}")


if __name__ == "__main__":
    main(sys.argv)
