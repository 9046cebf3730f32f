"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from floodgrid.queries import QUERIES  # noqa: E402
from floodgrid.queries import fixtures  # noqa: E402
from floodgrid.runtime import build_session  # noqa: E402

HEADLINE = [
    "zone_class_statistics",
    "flow_accumulation",
    "first_downstream_channel",
    "flood_index_normalised",
    "hazard_scenario_summary",
    "threshold_sensitivity",
    "connected_components",
    "distance_to_rivers",
    "stream_threshold_sweep",
    "confusion_by_zone_all",
    "positional_tolerance",
    "layer_zone_distributions",
    "nearest_neighbour_between_dates",
    "polygon_intersection_areas",
    "depression_filling",
    "slope_horn",
    "ranked_scene_triplets",
    "batch_completeness",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # Little data per task: merging it into 1 MiB partitions would idle the cores.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").count()
    times = {}
    for name in names:
        # Every query computes all its steps itself.
        fixtures.forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
