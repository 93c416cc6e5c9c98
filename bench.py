"""Time every registered query at one scale factor.

Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is planned from its source tables and fully executed into the
``noop`` sink (no collect to the driver). Environment:
BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated query names, optional).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = {x for x in os.environ.get("BENCH_ONLY", "").split(",") if x}

    from corefkit.registry import entries
    from corefkit.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="corefkit-bench")
    # Warm the JVM, code generation and the file cache once, outside the
    # timings: derive the shared pair table a single time.
    from corefkit.plans import fixtures as fx

    spark.range(1000).selectExpr("sum(id)").collect()
    fx.pairs(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name, e in sorted(entries().items()):
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            e.fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as ex:  # keep timing the rest
            errors[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "n_queries": len(times),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
