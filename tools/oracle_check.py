"""Run bound queries in Spark and their oracle SQL in DuckDB; compare rows, schema, values.

Usage: python tools/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.registry import ORACLE, QUERIES  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _spark_type(t):
    if t.startswith("array<"):
        return _spark_type(t[6:-1]) + "[]"
    return _TYPES.get(t, t)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        cols = df.columns
        if name not in ORACLE:
            print(f"{name:24s} rows={len(rows):7d} spark={t1-t0:6.2f}s  (no oracle)")
            continue
        res = con.execute(ORACLE[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        t2 = time.time()
        stypes = {f.name: _spark_type(f.dataType.simpleString()) for f in df.schema.fields}
        otypes = {d[0]: str(d[1]) for d in res.description}
        tdiff = {c: (stypes.get(c), otypes.get(c)) for c in stypes if stypes.get(c) != otypes.get(c)}
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2 and not tdiff
        bad += not ok
        print(f"{name:24s} rows={len(rows):7d}/{len(orows):7d} spark={t1-t0:6.2f}s duck={t2-t1:6.2f}s "
              f"{'OK' if ok else 'MISMATCH'}")
        if not ok:
            if tdiff:
                print("   types", tdiff)
            if sorted(cols) != sorted(ocols):
                print("   cols", cols, ocols)
            s1, s2 = set(l1), set(l2)
            for x in list(s1 - s2)[:3]:
                print("   spark only:", x[:300])
            for x in list(s2 - s1)[:3]:
                print("   duck  only:", x[:300])
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
