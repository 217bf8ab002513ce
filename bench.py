"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  directory of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

``silver`` is the cost of joining, canonicalising, scoring and writing the trips once; the marts
read that table. Every query is run to its end on all of its rows through the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from curbflow.session import build_session, clear_scratch  # noqa: E402
from curbflow.workload import all_queries  # noqa: E402
from curbflow.workload.trips import drop_layers, mart, silver_trips  # noqa: E402

HEADLINE = (
    "bronze_reconciliation",
    "silver_union",
    "dq_rule_counts",
    "reconciliation",
    "enrich_zones",
    "daily_demand",
    "hourly_profile",
    "service_financials",
    "route_performance",
    "tip_factors",
    "timeseries_base",
    "zone_profile",
    "daily_anomalies",
    "demand_labels",
    "time_features",
    "zone_features",
    "star_routes",
    "measures_route",
    "page_01",
    "page_05",
    "contract_d02",
    "page_links",
    "audit_flat",
    "file_current_state",
    "forecast",
    "segment_zones",
    "classify_demand",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "curbflow-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start-up is not a query
    timings: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - began, 3)

    timed("silver", lambda: silver_trips(spark, sf_dir))
    for name in ("daily", "hourly", "routes"):
        timed(f"mart_{name}", lambda name=name: mart(spark, sf_dir, name))
    queries = all_queries()
    for name in HEADLINE:
        timed(
            name,
            lambda name=name: queries[name](spark, sf_dir)
            .write.format("noop")
            .mode("overwrite")
            .save(),
        )
    drop_layers(spark)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
