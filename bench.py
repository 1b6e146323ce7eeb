"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   directory of the star tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default: the headline queries), or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shopmetrics.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "revenue_by_branch", "master_detail", "units_by_product", "revenue_by_category", "tx_by_cashier", "tx_by_hour",
    "reorder_alert", "sales_list", "sales_kpis_month", "sales_kpis_all", "daily_sales", "by_cashier", "by_payment",
    "home_metrics", "top5_products", "inventory_status", "movement_history", "catalogue_search",
    "expenses_by_category", "profit_and_loss", "business_report", "product_pnl", "sheet_summary", "period_stats",
    "fx_convert", "shift_breakdown", "sales_alerts", "post_sales", "post_sales_inventory", "apply_movements",
    "void_sales", "process_returns", "add_products", "edit_products_inventory", "reconcile_tills", "load_dedup",
    "process_returns_inventory", "post_sales_items", "till_history", "activity_view", "returns_history", "sale_item_list",
    "cart_merge", "text_labels", "hotel_bookings", "returnable_sales", "upsert_staff",
]


def run(spark: SparkSession, name: str, directory: str) -> float:
    """Seconds to work out every row and column of a query."""
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shopmetrics-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # The fact tables of a local run are small enough to be broadcast, which would leave one core working.
        .config("spark.sql.autoBroadcastJoinThreshold", "2MB")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:  # start-up and compilation of the JVM are not a query's time
        run(spark, name, directory)
    seconds = {name: round(min(run(spark, name, directory) for _ in range(2)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(directory)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
