"""Expenses, profit and loss, and the small business reports (R11, R12, R20-R24; A15-A17, A19-A22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.money import (
    above, as_money, converted, line_total, margin_pct, product_profit, profit, profit_verdict,
)
from shopmetrics.functions.predicates import filled, not_voided
from shopmetrics.operators.rollup import side_by_side, sums_per_key
from shopmetrics.sources.sinks import metric_rows


def _zero_if_none(c: str):
    return F.coalesce(F.sum(c), F.lit(0))


def expense_list(expenses: DataFrame, users: DataFrame) -> DataFrame:
    """R11/J9. Every expense with who recorded it, newest first."""
    names = users.select(F.col("user_id").alias("recorded_by"), "full_name")
    return (
        expenses.join(names, "recorded_by")
        .select(
            "expense_id", "expense_date", "category", "description", "amount",
            F.col("full_name").alias("recorded_by"),
        )
        .orderBy(F.desc("expense_date"), F.desc("expense_id"))
    )


def expenses_by_category(expenses: DataFrame, users: DataFrame) -> DataFrame:
    """A15. Amount per category, highest first."""
    return (
        sums_per_key(expenses, "recorded_by", users, "user_id", [], ["amount"], ["category"])
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("amount").alias("amount"))
        .orderBy(F.desc("amount"), "category")
    )


def total_expenses(expenses: DataFrame, users: DataFrame) -> DataFrame:
    """A15. One row."""
    return sums_per_key(expenses, "recorded_by", users, "user_id", [], ["amount"]).agg(
        _zero_if_none("amount").alias("expenses")
    )


def cost_of_goods_sold(sales: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """A16. Units of sales that count, at today's cost price. One row."""
    sold = items.select("sale_id", "product_id", "quantity").join(
        sales.filter(not_voided()).select("sale_id"), "sale_id"
    )
    units = sums_per_key(sold, "product_id", products, "product_id", ["cost_price"], ["quantity"])
    return units.agg(F.coalesce(F.sum(line_total("quantity", "cost_price")), F.lit(0)).alias("cogs"))


def profit_and_loss(
    sales: DataFrame, users: DataFrame, items: DataFrame, products: DataFrame, expenses: DataFrame
) -> DataFrame:
    """R12/A17. Revenue (net of discounts, before refunds), cost of goods, gross, expenses and net profit."""
    revenue = sums_per_key(
        sales.filter(not_voided()), "cashier_id", users, "user_id", [], ["total_amount"]
    ).agg(_zero_if_none("total_amount").alias("revenue"))
    row = side_by_side(
        revenue, cost_of_goods_sold(sales, items, products), total_expenses(expenses, users)
    )
    gross = profit("revenue", "cogs")
    net = gross - F.col("expenses")
    return row.select("revenue", "cogs", gross.alias("gross_profit"), "expenses", net.alias("net_profit"))


def business_report(businesses: DataFrame) -> DataFrame:
    """R20. Profit, margin and verdict per business (``name, revenue, expenses``)."""
    return businesses.select(
        F.col("name").alias("business"), "revenue", "expenses",
        profit("revenue", "expenses").alias("profit"),
    ).withColumns(
        {"margin_pct": margin_pct("profit", "revenue", scale=2), "verdict": profit_verdict("profit")}
    )


def product_pnl(products: DataFrame) -> DataFrame:
    """R21/P19. Profit and loss of each row (``product, selling_price, cost_price, quantity``); blank names drop."""
    return products.filter(filled("product")).withColumns(
        product_profit("selling_price", "cost_price", "quantity")
    )


def pnl_summary(pnl: DataFrame, order: str = "row_no") -> DataFrame:
    """R21/A20/A21. Totals, and the row with the highest profit; the first of equals by ``order``."""
    rank = F.struct(F.col("profit"), -F.col(order))
    return pnl.agg(
        _zero_if_none("revenue").alias("revenue"),
        _zero_if_none("cost").alias("cost"),
        _zero_if_none("profit").alias("profit"),
        F.max_by("product", F.when(F.col("profit").isNotNull(), rank)).alias("best_performer"),
    )


def best_row(df: DataFrame, name: str, measure: str, order: str) -> DataFrame:
    """A20. Name of the row with the highest measure, without grouping; the first of equals by ``order``."""
    rank = F.struct(F.col(measure), -F.col(order))
    return df.agg(F.max_by(name, F.when(F.col(measure).isNotNull(), rank)).alias(f"best_{name}"))


def sheet_totals(records: DataFrame) -> DataFrame:
    """R22/A19/A21. Revenue, best seller by units (ties: first name) and row count, in one row."""
    per_product = records.groupBy("product").agg(
        F.sum(line_total("quantity", "price")).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count("*").alias("rows"),
    )
    rank = F.struct(-F.col("units"), F.col("product"))
    return per_product.agg(
        _zero_if_none("revenue").alias("total_revenue"),
        F.min_by("product", F.when(F.col("product").isNotNull(), rank)).alias("best_seller"),
        _zero_if_none("rows").alias("total_transactions"),
    )


def sheet_summary(records: DataFrame) -> DataFrame:
    """R22/K3. The same as (metric, value) rows."""
    # Metric names.
    return metric_rows(
        sheet_totals(records),
        {
            "total_revenue": "Total Revenue",
            "best_seller": "Best Selling Product",
            "total_transactions": "Total Transactions",
        },
    )


def period_stats(df: DataFrame, key: str, measure: str, threshold: float = 3000) -> DataFrame:
    """R23/A22. Total, highest, lowest and average (2 decimals) per ``key``, and whether the average is above."""
    count = F.count(measure).cast("decimal(18,0)")
    return (
        df.groupBy(key)
        .agg(
            F.sum(measure).alias("total"),
            F.max(measure).alias("highest"),
            F.min(measure).alias("lowest"),
            as_money(F.bround(F.try_divide(F.sum(measure), count), 2)).alias("average"),
        )
        .withColumn("above_threshold", above("average", threshold))
    )


def fx_convert(amounts: DataFrame, rates: DataFrame, targets: Sequence[str], amount: str = "amount") -> DataFrame:
    """R24/P17. Each amount in each target currency; NULL where no rate is known.

    The rates side has at most one row per target, a list the caller writes out, so broadcasting
    it is safe at any size of the rates table.
    """
    wanted = rates.filter(F.col("currency").isin(*targets)).groupBy("currency").agg(F.max("rate").alias("rate"))
    spread = amounts.withColumn("currency", F.explode(F.array(*[F.lit(t) for t in targets])))
    return (
        spread.join(F.broadcast(wanted), "currency", "left")
        .withColumn("converted", converted(amount, "rate"))
        .drop("rate")
    )
