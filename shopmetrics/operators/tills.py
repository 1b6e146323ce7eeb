"""Cash expected in a till, and till reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import on_day
from shopmetrics.functions.money import as_total, till_verdict
from shopmetrics.functions.predicates import not_voided
from shopmetrics.operators.activity import log_rows

CASH = "cash"


def of_shift(sales: DataFrame, cashier_id=None, day=None) -> DataFrame:
    """F9. Sales that count for a shift; without arguments, for every cashier and day."""
    kept = sales.filter(not_voided())
    if cashier_id is not None:
        kept = kept.filter(F.col("cashier_id") == F.lit(cashier_id))
    if day is not None:
        kept = kept.filter(on_day("sale_date", day))
    return kept


def shift_breakdown(sales: DataFrame, cashier_id=None, day=None) -> DataFrame:
    """A13/R15. Total and count per payment method of each shift."""
    return (
        of_shift(sales, cashier_id, day)
        .groupBy("cashier_id", "sale_date", "payment_method")
        .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total"), F.count("*").alias("txns"))
    )


def expected_cash(sales: DataFrame, cash: str = CASH) -> DataFrame:
    """A14/R15. Cash taken per cashier and day; shifts that took none are not listed."""
    return (
        of_shift(sales)
        .filter(F.col("payment_method") == cash)
        .groupBy("cashier_id", "sale_date")
        .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("expected_cash"))
    )


def expected_cash_of(sales: DataFrame, cashier_id, day, cash: str = CASH) -> DataFrame:
    """A14. One row for one shift; zero when nothing was taken."""
    return (
        of_shift(sales, cashier_id, day)
        .filter(F.col("payment_method") == cash)
        .agg(F.coalesce(F.sum("total_amount"), F.lit(0)).alias("expected_cash"))
    )


def reconcile_tills(sales: DataFrame, declarations: DataFrame, cash: str = CASH) -> dict[str, DataFrame]:
    """W10. Compare declared cash with expected cash, for every declaration.

    ``declarations``: ``cashier_id, recon_date, declared_cash, notes, submitted_by, created_at``.
    """
    expected = expected_cash(sales, cash).withColumnRenamed("sale_date", "recon_date")
    compared = declarations.join(expected, ["cashier_id", "recon_date"], "left").withColumns(
        {
            "expected_cash": as_total(F.coalesce("expected_cash", F.lit(0))),
            "declared_cash": as_total("declared_cash"),
        }
    )
    rows = compared.withColumn("difference", as_total(F.col("declared_cash") - F.col("expected_cash")))
    return {
        "till_reconciliations": rows.select(
            "cashier_id", "recon_date", "expected_cash", "declared_cash", "difference", "notes",
            "submitted_by", "created_at",
        ),
        "verdicts": rows.select(
            "cashier_id", "recon_date", till_verdict("difference").alias("verdict"),
            F.abs("difference").alias("amount"),
        ),
        "activity": log_rows(
            rows, "TILL RECONCILIATION", "submitted_by", "created_at",
            "recon_date", "expected_cash", "declared_cash", "difference",
        ),
    }
