"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (np.floating,)):
        return None if np.isnan(v) else round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _canon(v.asDict())
    return v


def canon_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            ts = time.time() - t0
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        if name not in sqls:
            results[name] = f"rows-only {len(srows)}"
            if verbose:
                print(f"{name:28s} rows-only spark={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            t1 = time.time()
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            td = time.time() - t1
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = canon_rows(scols, srows), canon_rows(dcols, drows)
        ok = ok_cols and a == b
        results[name] = "OK" if ok else "MISMATCH"
        if verbose:
            print(f"{name:28s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)} {ts:.1f}s/{td:.1f}s", flush=True)
            if not ok_cols:
                print("   cols", sorted(scols), sorted(dcols))
            elif not ok:
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:2])
                print("   only duck :", list(sb - sa)[:2])
    return results


if __name__ == "__main__":
    from lexiflow.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v not in ("OK",) and not v.startswith("rows-only")}
    print("SUMMARY", len(res), "queries,", len(bad), "not OK:", sorted(bad))
