"""Benchmark: run the bound queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed to completion (a full aggregate over its output, so every row and
column is produced) and timed; ``value`` is the sum over queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tessera.plans.registry import QUERIES  # noqa: E402
from tessera.session import build_session  # noqa: E402


def _consume(df):
    """Force full evaluation without moving the result to the driver."""
    cols = [F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).alias("h")]
    return df.select(*cols).agg(F.count(F.lit(1)), F.bit_xor("h")).collect()[0][0]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or sorted(QUERIES)
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))
    spark = build_session(f"local[{cpus}]", parts, extra={"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="tessera-shared-")})
    # warm-up: JVM, parquet footers and codegen caches
    _consume(QUERIES["line_count"](spark, sf_dir))
    times, rows = {}, {}
    for name in names:
        t0 = time.time()
        rows[name] = _consume(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s rows={rows[name]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
