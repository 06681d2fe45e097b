"""Time the headline queries and print one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stopwise.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "next_day_by_driver",
    "six_day_by_date",
    "same_day_by_driver",
    "interior_mon_tue",
    "interior_eight_day_by_roster",
    "scenario_legend",
    "roster_legend",
    "bounding_boxes",
    "routes_by_driver",
    "routes_by_date",
    "customer_routes_by_nation",
    "route_legs",
    "stop_details",
    "customer_master",
    "facet_values",
    "facet_filter_summary",
    "colored_markers",
    "customer_markers",
)

# Timed too, but left out of the total, which stays comparable from round to round.
FURTHER = (
    "networks_from_file",
    "customer_routes_in_rounds",
    "written_report",
    "stream_refresh",
    "facet_summaries",
    "facet_search_indexed",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run starts the virtual machine's compiler and the Python workers.
    QUERIES["routes_by_driver"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE + FURTHER:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": {n: seconds[n] for n in HEADLINE},
                "further_queries": {n: seconds[n] for n in FURTHER},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
