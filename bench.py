"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.session import local_session  # noqa: E402
from tabloom.workload.queries import QUERIES  # noqa: E402

HEADLINE = ["row_scores", "detect_headers", "map_standard", "map_deep", "reshape"]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("tabloom-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "has_data_below", sf_dir)  # warm-up
    times = {name: run(spark, name, sf_dir) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
