"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's plan runs in full through the ``noop`` sink (nothing collected
to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postlens.plans.registry import QUERIES  # noqa: E402
from postlens.session import build_session  # noqa: E402

HEADLINE = [
    "train_nb", "clean_text", "score_posts", "top_posts_per_keyword", "analyze_keywords",
    "agreement_by_keyword", "posts_per_keyword", "title_join_fanout", "title_join_labels",
    "stream_to_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    # JVM/JIT warm-up outside the timings, on a different (smallest) data folder
    # so that no data or file caches of the measured folder are warmed.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", str(Path(sf_dir).parent / "sf0.001"))
    if Path(warm_dir).exists() and Path(warm_dir).resolve() != Path(sf_dir).resolve():
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
