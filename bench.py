"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every query is built and written to the no-op sink, so all rows and columns are computed.
A first pass over the small tables warms the JVM and is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "compact_features",
    "wide_features",
    "window_features",
    "early_window_features",
    "source_audit",
    "grouped_kfold",
    "standardise",
    "auroc",
    "calibration_curve",
    "paired_contrast",
    "telemetry_rollup",
]
REPEATS = 3


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = re.sub(r"sf[0-9.]+/?$", "sf0.001", folder)
    warm = small if os.path.isdir(small) else folder
    for name in HEADLINE:
        run(spark, name, warm)
    seconds = {name: round(min(run(spark, name, folder) for _ in range(REPEATS)), 3) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)/?$", folder)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
        "cpus": cpus,
        "timing": f"best of {REPEATS}",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
