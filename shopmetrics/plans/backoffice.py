"""Staff, log, till and returns histories, and the sales alerts (R13, R16-R18; J8, J10, J11; F10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import days_before, on_day
from shopmetrics.functions.predicates import not_voided
from shopmetrics.operators.rollup import in_order, newest, side_by_side
from shopmetrics.plans.stock import low_stock_count


def staff_list(users: DataFrame) -> DataFrame:
    """Staff by name, without sign-in codes."""
    return users.select("user_id", "full_name", "role", "is_active", "created_at").orderBy("full_name", "user_id")


def active_user(users: DataFrame, code: str) -> DataFrame:
    """F10. The active user with this code, the first by id; sign-in itself is not part of this library."""
    return users.filter((F.col("code") == code) & F.col("is_active")).orderBy("user_id").limit(1).drop("code")


def activity_view(log: DataFrame, users: DataFrame, k: int = 100) -> DataFrame:
    """R13/J8. The newest log rows."""
    order = [("logged_at", True), ("log_id", True)]
    return (
        newest(log, order, {"user_id": users.select("user_id")}, k)
        .join(users.select("user_id", "full_name", "role"), "user_id")
        .orderBy(*in_order(order))
        .select("logged_at", "full_name", "role", "action", "details")
    )


def till_history(tills: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """R16/J10. The newest reconciliations, with the cashier and who handed them in."""
    order = [("recon_date", True), ("created_at", True), ("cashier_id", False), ("submitted_by", False), ("declared_cash", False)]
    people, ids = users.select("user_id", "full_name"), users.select("user_id")
    return (
        newest(tills, order, {"cashier_id": ids, "submitted_by": ids}, k)
        .join(people.toDF("cashier_id", "cashier"), "cashier_id")
        .join(people.toDF("submitted_by", "submitter"), "submitted_by")
        .orderBy(*in_order(order))
        .select(
            "recon_date", "cashier", "expected_cash", "declared_cash", "difference", "notes",
            F.col("submitter").alias("submitted_by"), "created_at",
        )
    )


def returns_history(returns: DataFrame, products: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """R17/J11. The newest returns."""
    order = [("return_date", True), ("sale_id", True), ("product_id", False), ("quantity", False), ("refund_amount", False)]
    known = {"product_id": products.select("product_id"), "processed_by": users.select("user_id")}
    return (
        newest(returns, order, known, k)
        .join(products.select("product_id", "product_name"), "product_id")
        .join(users.select(F.col("user_id").alias("processed_by"), "full_name"), "processed_by")
        .orderBy(*in_order(order), "reason", "full_name")
        .select(
            "return_date", "sale_id", "product_name", "quantity", "refund_amount", "reason",
            F.col("full_name").alias("processed_by"),
        )
    )


# yesterday's sales raise an alert below and above these shares of the day before.
DROP_BELOW = "0.8"
GAIN_ABOVE = "1.2"

# Alert texts.
LOW_STOCK_TEXT = "%d product(s) are low on stock"
DROP_TEXT = "Yesterday's sales were %d%% lower than the previous day"
GAIN_TEXT = "Yesterday's sales were %d%% higher than the previous day"


def sales_alerts(sales: DataFrame, products: DataFrame, inventory: DataFrame, as_of) -> DataFrame:
    """R18. Alerts of the day as rows of (level, alert, value, message); none when all is well.

    Low stock, and yesterday's sales against the day before: strictly below 80 % or above 120 %.
    ``value`` is the number of products, or the change in whole percent.
    """
    yesterday, before = days_before(as_of, 1), days_before(as_of, 2)

    def takings(day):
        return F.coalesce(F.sum(F.when(on_day("sale_date", day), F.col("total_amount"))), F.lit(0))

    days = sales.filter(not_voided() & F.col("sale_date").between(F.lit(before), F.lit(yesterday))).agg(
        takings(yesterday).alias("last"), takings(before).alias("prev")
    )
    row = side_by_side(low_stock_count(products, inventory), days)

    change = F.try_divide((F.col("last") - F.col("prev")) * 100, F.col("prev"))
    percent = F.bround(F.abs(change), 0).cast("bigint")
    compared = F.col("prev") > 0
    dropped = compared & (F.col("last") < F.col("prev") * F.lit(DROP_BELOW).cast("decimal(2,1)"))
    gained = compared & (F.col("last") > F.col("prev") * F.lit(GAIN_ABOVE).cast("decimal(2,1)"))

    def alert(when, level, name, value, message):
        return F.when(
            when,
            F.struct(
                F.lit(level).alias("level"), F.lit(name).alias("alert"), value.alias("value"), message.alias("message")
            ),
        )

    alerts = F.array(
        alert(
            F.col("low_stock") > 0, "warning", "low_stock", F.col("low_stock"),
            F.format_string(LOW_STOCK_TEXT, F.col("low_stock")),
        ),
        alert(
            dropped, "error", "sales_drop", percent,
            F.format_string(DROP_TEXT, percent),
        ),
        alert(
            gained, "success", "sales_gain", percent,
            F.format_string(GAIN_TEXT, percent),
        ),
    )
    return row.select(F.inline(F.filter(alerts, lambda a: a.isNotNull())))
