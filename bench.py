"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query is planned anew and its result is computed in full (noop sink); the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from tillwise.session import local_session  # noqa: E402

HEADLINE = [
    "kpi_long",
    "kpi_by_category",
    "top_products",
    "monthly_revenue",
    "customer_segments",
    "worst_products",
    "trend_monthly",
    "trend_insights",
    "rca_contributors",
    "rca_explanations",
    "forecast_rows",
    "forecast_by_category",
    "recommendations_all",
    "quality_report",
    "clean_rows",
    "column_report",
    "stored_sales",
    "numbered_rows",
    "revenue_ytd",
    "star_measures",
]


def seconds(spark, name: str, folder: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cores, "tillwise-bench", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cores}
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(min(seconds(spark, name, folder) for _ in range(2)), 3) for name in HEADLINE}
    spark.stop()
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
