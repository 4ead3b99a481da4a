"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
Compares column names, row count and the sorted multiset of rows (floats
rounded to 6 significant digits).
"""
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from cartograph.plans.registry import load_all  # noqa: E402
from cartograph.session import get_session  # noqa: E402
from cartograph.sources.shop import DRIVER_TABLES  # noqa: E402

ALL_TABLES = DRIVER_TABLES + ("embeddings", "pages", "conversations")


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~null",)
        if v.is_integer() and abs(v) < 2**53:
            return ("i", int(v))
        return ("f", float(f"{v:.6g}"))
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if hasattr(v, "tolist"):
        return ("l", tuple(norm(x) for x in v.tolist()))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, norm(x)) for k, x in v.items())))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return ("t", s.replace("T", " ")[:26].rstrip("0").rstrip(".") if " " in s or "T" in s else s)
    return ("s", str(v))


def rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, q in reg.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if q.oracle is None:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            odf = con.sql(q.oracle).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows(sdf)
        oc, orr = rows(odf)
        if sc != oc:
            print(f"FAIL {name}: columns {sc} vs {oc}")
            bad += 1
        elif len(sr) != len(orr):
            print(f"FAIL {name}: rows {len(sr)} vs {len(orr)}")
            bad += 1
        elif sr != orr:
            diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
            print(f"FAIL {name}: values differ ({len(sr)} rows) e.g. {diff}")
            bad += 1
        else:
            print(f"OK   {name}: {len(sr)} rows {t1 - t0:.1f}s")
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
