"""Rows of the activity log, and texts of stock movements (K4, P20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.money import ColumnOrName, col

# Reasons of the stock movements that sales and returns write.
SALE_REASON = "Sale ID %s"
RETURN_REASON = "Return from Sale #%s: %s"

# Actions of the log and the text of their details.
DETAILS = {
    "SALE": "Sale ID %s - %s %s",
    "STOCK MOVEMENT": "%s - %s units of %s",
    "STOCK IN": "%s units of %s recorded",
    "ADD PRODUCT": "Added %s",
    "STOCK ADJUSTMENT": "%s: %s %s | Reason: %s",
    "EDIT PRODUCT": "Updated %s",
    "DEACTIVATE PRODUCT": "Deactivated %s",
    "REACTIVATE PRODUCT": "Reactivated %s",
    "ADD STAFF": "Added %s as %s",
    "UPDATE STAFF": "Updated %s",
    "EXPENSE": "%s - %s %s",
    "VOID": "Sale ID %s voided. Reason: %s",
    "TILL RECONCILIATION": "Date: %s | Expected: %s | Declared: %s | Diff: %s",
    "RETURN": "Sale #%s — %s x%s — %s %s",
}
NO_REASON = "N/A"


def worded(pattern: str, *values: ColumnOrName) -> Column:
    """``pattern`` with the text of each value in its place."""
    return F.format_string(pattern, *[col(v).cast("string") for v in values])


def log_rows(df: DataFrame, action: str, user: str, at: str, *values: ColumnOrName) -> DataFrame:
    """One log row per row of ``df``: who, what, its details in words, and when."""
    return df.select(
        F.col(user).alias("user_id"),
        F.lit(action).alias("action"),
        worded(DETAILS[action], *values).alias("details"),
        F.col(at).alias("logged_at"),
    )
