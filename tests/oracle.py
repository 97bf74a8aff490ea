"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows (columns sorted by name; floats compared after rounding).
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        vals = []
        for v in rec:
            try:
                if v != v:  # NaN / NaT
                    v = None
            except (TypeError, ValueError):
                pass
            vals.append(_norm(v))
        out.append(tuple(vals))
    return cols, out


def compare(spark, name: str, sf_dir: str, verbose: bool = True) -> dict:
    import __spark_entry__ as entry

    sdf = entry.queries()[name](spark, sf_dir)
    spdf = sdf.toPandas()
    sql = entry.oracle_sql()[name]
    dpdf = duck(sf_dir).execute(sql).df()
    res = {"name": name, "spark_rows": len(spdf), "duck_rows": len(dpdf)}
    scols, srows = rows_of(spdf)
    dcols, drows = rows_of(dpdf)
    res["columns_match"] = scols == dcols
    if scols != dcols:
        res["detail"] = f"spark cols {scols} vs duck cols {dcols}"
        res["ok"] = False
        return res
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    srows.sort(key=key)
    drows.sort(key=key)
    res["ok"] = srows == drows
    res["spark_types"] = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    res["duck_types"] = {c: str(t) for c, t in zip(dpdf.columns, dpdf.dtypes)}
    if not res["ok"] and verbose:
        sset, dset = set(srows), set(drows)
        only_s = [r for r in srows if r not in dset][:3]
        only_d = [r for r in drows if r not in sset][:3]
        res["detail"] = {"cols": scols, "only_spark": only_s, "only_duck": only_d}
    return res


if __name__ == "__main__":
    from cribra.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = local_session(8, 8)
    import __spark_entry__ as entry

    names = names or sorted(entry.oracle_sql())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf)
        except Exception as exc:  # report and go on
            r = {"name": n, "ok": False, "detail": repr(exc)[:2000]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "FAIL"), n, r.get("spark_rows"), r.get("duck_rows"),
              "" if r["ok"] else r.get("detail"), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
