"""Wall seconds of the headline queries: median of BENCH_RUNS runs after one warm-up, as one JSON line.

BENCH_SF_DIR   directory of the check tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_RUNS     timed runs per query (default 3)
BENCH_QUERIES  space-separated keys, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cropline.session import build_session  # noqa: E402
from cropline_check.queries import QUERIES  # noqa: E402

HEADLINE = (
    "batch_detail", "batch_detail_fanout", "bin_delivery", "bin_usage", "bins_for_batch", "transfers",
    "season_bounds", "packout_to_date", "packout_regression", "harvest_by_site", "harvest_rate", "pick_share",
    "cumulative_harvest", "tipped_by_site", "defect_assessment_summary", "defect_profile", "top_defects",
    "phyto_findings", "interception_rate", "pest_counts", "size_moments", "size_band_pivot", "size_histogram",
    "season_kpis",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    keys = list(QUERIES) if chosen == ["all"] else chosen or list(HEADLINE)
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for key in keys:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(times[1:] or times), 4)
    spark.stop()
    print(json.dumps({
        "metric": "total wall seconds of the headline queries (median of runs)",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
