"""Run catalogue queries in Spark and their oracle SQL in DuckDB and compare.

CLI: ``python tests/oracle_compare.py [sf_dir] [name ...]``. Comparison is
order-insensitive: columns by name, rows sorted, floats exact (and, to help
debugging, also within 1e-9 relative).
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except Exception:
        pass
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except Exception:
        pass
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(v) for v in rec))
    out.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, out


def close(a, b):
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return False


def compare(spark_pdf, duck_pdf):
    c1, r1 = rows_of(spark_pdf)
    c2, r2 = rows_of(duck_pdf)
    if c1 != c2:
        return False, f"columns differ: {c1} vs {c2}"
    if len(r1) != len(r2):
        return False, f"row count {len(r1)} vs {len(r2)}"
    exact = r1 == r2
    if exact:
        return True, "exact"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    tol = all(all(close(x, y) for x, y in zip(a, b)) for a, b in bad)
    return False, f"{'within-tolerance' if tol else 'MISMATCH'} {len(bad)} rows, first: {bad[0]}"


def main(argv):
    from tessera.session import get_spark
    import __spark_entry__ as entry
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = get_spark("local[8]", 8)
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            pdf = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"\n{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            failed.append(name)
            continue
        dt = time.time() - t
        if name not in sqls:
            print(f"\n{name:32s} rows={len(pdf):6d} (no oracle) {dt:.1f}s")
            continue
        try:
            dpdf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"\n{name:32s} DUCKDB ERROR {str(e)[:400]}")
            failed.append(name)
            continue
        ok, msg = compare(pdf, dpdf)
        print(f"\n{name:32s} rows={len(pdf):6d} {'OK ' if ok else 'BAD'} {msg[:300]} {dt:.1f}s")
        if not ok:
            failed.append(name)
    print("FAILED:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
