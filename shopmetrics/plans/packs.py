"""Report packs written to storage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from shopmetrics.functions.dates import hhmm
from shopmetrics.plans.sales import SUMMARIES, master_detail, one_summary, sales_list, summary_rows
from shopmetrics.plans.stock import inventory_status
from shopmetrics.sources.sinks import write_csv, write_ordered_csv, write_reports


def write_sales_pack(
    headers: DataFrame, items: DataFrame, products: DataFrame, reorder: DataFrame, directory: str,
    unit_price: str = "unit_price",
) -> None:
    """R2. The detail list, its five summaries and the reorder list, one dataset directory each.

    The six-table join runs once: the detail is stored first. One pass over it works out all summaries, and their
    rows, far fewer, are stored and parted.
    """
    detail = master_detail(headers, items, products, unit_price).withColumn("sale_time", hhmm("sale_time"))
    write_reports({"master_data": detail}, directory)
    stored = headers.sparkSession.read.schema(detail.schema).parquet(os.path.join(directory, "master_data"))
    write_reports({"summaries": summary_rows(stored)}, directory)
    figures = headers.sparkSession.read.parquet(os.path.join(directory, "summaries"))
    write_reports({**{name: one_summary(figures, name) for name in SUMMARIES}, "reorder_alert": reorder}, directory)


def export_csv(
    sales: DataFrame, users: DataFrame, products: DataFrame, inventory: DataFrame, directory: str,
    ordered: bool = False,
) -> None:
    """R19. All sales, voided ones included, and the inventory, as CSV; ``ordered`` for files that join to one."""
    write = write_ordered_csv if ordered else write_csv
    write(sales_list(sales, users), os.path.join(directory, "sales_report"))
    write(inventory_status(products, inventory), os.path.join(directory, "inventory_report"))
