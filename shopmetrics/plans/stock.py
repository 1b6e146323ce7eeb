"""Stock reports (R3, R7-R10; A3, A24, A25; O1, O4, O5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.labels import active_label, stock_status
from shopmetrics.functions.money import margin_pct, profit
from shopmetrics.functions.predicates import (
    ANY, filled, has_status, in_category, low_stock, name_contains, needs_reorder, sellable,
)
from shopmetrics.operators.rollup import in_order, newest


def reorder_alert(inventory: DataFrame, products: DataFrame, branches: DataFrame) -> DataFrame:
    """R3/J6. Stock at or below its reorder level, per branch, lowest first."""
    return (
        inventory.join(products.select("product_id", "product_name", "category", "reorder_level"), "product_id")
        .filter(needs_reorder())
        .join(branches.select("branch_id", "branch_name"), "branch_id")
        .orderBy("quantity", "product_id", "branch_id")
        .select(
            "product_name", "category", F.col("quantity").alias("current_stock"), "reorder_level", "branch_name"
        )
    )


def _active_stock(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """J1 on active products."""
    return (
        products.filter("is_active")
        .join(inventory.select("product_id", "quantity"), "product_id")
        .withColumn("status", stock_status("quantity", "reorder_level"))
    )


def low_stock_count(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """A3. One row."""
    return _active_stock(products, inventory).filter(needs_reorder()).agg(F.count("*").alias("low_stock"))


def inventory_status(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """R7. Stock of active products with its status, lowest first."""
    return (
        _active_stock(products, inventory)
        .orderBy("quantity", "product_id")
        .select(
            "product_name", "category", "selling_price", "cost_price", "quantity", "reorder_level", "status"
        )
    )


def inventory_counts(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """A25. Active products with stock records, and how many of them are low."""
    return _active_stock(products, inventory).agg(
        F.count("*").alias("total_products"), F.count_if(low_stock()).alias("low_stock")
    )


def low_stock_items(products: DataFrame, inventory: DataFrame, k: int | None = None) -> DataFrame:
    """F12/O5. Active products that are low, lowest first; ``k`` for a preview."""
    low = (
        _active_stock(products, inventory)
        .filter(low_stock())
        .orderBy("quantity", "product_id")
        .select("product_name", "category", "quantity", "reorder_level")
    )
    return low if k is None else low.limit(k)


def movement_history(movements: DataFrame, products: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """R8/J7. The newest stock movements."""
    order = [("movement_date", True), ("movement_id", True)]
    known = {"product_id": products.select("product_id"), "recorded_by": users.select("user_id")}
    return (
        newest(movements, order, known, k)
        .join(products.select("product_id", "product_name"), "product_id")
        .join(users.select(F.col("user_id").alias("recorded_by"), "full_name"), "recorded_by")
        .orderBy(*in_order(order))
        .select("movement_date", "product_name", "movement_type", "quantity", "reason", "full_name")
    )


def catalogue(
    products: DataFrame, inventory: DataFrame, search: str | None = None, category: str = ANY, status: str = ANY
) -> DataFrame:
    """R9/J2. The catalogue with margin and stock (none counts as zero), by name, filtered as asked."""
    wanted = products.filter(
        name_contains("product_name", search) & in_category("category", category) & has_status("is_active", status)
    )
    return (
        wanted.join(inventory.select("product_id", "quantity"), "product_id", "left")
        .withColumns(
            {
                "margin_pct": margin_pct(
                    profit("selling_price", "cost_price"), "selling_price", scale=1, on_zero=0
                ),
                "quantity": F.coalesce("quantity", F.lit(0)),
                "status": active_label("is_active"),
            }
        )
        .orderBy("product_name", "product_id")
        .select(
            "product_name", "category", "barcode", "cost_price", "selling_price", "margin_pct", "quantity",
            "reorder_level", "status",
        )
    )


def categories(products: DataFrame) -> DataFrame:
    """A24."""
    return products.filter(filled("category")).select("category").distinct().orderBy("category")


def available_products(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """R10/F1. What can be sold now."""
    return (
        products.filter("is_active")
        .join(inventory.select("product_id", "quantity"), "product_id")
        .filter(sellable())
        .select("product_id", "product_name", "selling_price", "quantity")
    )
