"""Time the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_QUERIES (comma-separated
names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from dripline.session import configure  # noqa: E402
from verification.star_queries import QUERIES  # noqa: E402

HEADLINE = [
    "journey_summary", "channel_performance", "daily_trends", "journey_daily", "journey_weekly",
    "kpi_totals", "journey_channel_totals", "journey_financials", "legacy_summary",
    "pivot_sent", "channel_breakdown_wide", "row_metrics", "campaign_details", "details_page",
    "filter_spec", "filter_domains", "dedupe_latest", "combine_reports", "clean_numeric",
    "performance_tiers", "high_value_journeys", "top_roi_10", "sort_performance",
    "conversion_funnel", "report_performers", "summary_display",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One unmeasured run starts the JVM and loads the classes.
    QUERIES["journey_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
