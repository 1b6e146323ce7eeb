"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmetrics.functions.labels import ACTIVE, LOW_STOCK
from shopmetrics.functions.money import ColumnOrName, col

ANY = "All"


def not_voided(is_voided: ColumnOrName = "is_voided") -> Column:
    """F2. A sale whose flag is unknown does not count."""
    return ~col(is_voided)


def sellable(is_active: ColumnOrName = "is_active", quantity: ColumnOrName = "quantity") -> Column:
    """F1."""
    return col(is_active) & (col(quantity) > 0)


def needs_reorder(quantity: ColumnOrName = "quantity", reorder_level: ColumnOrName = "reorder_level") -> Column:
    """F6."""
    return col(quantity) <= col(reorder_level)


def name_contains(name: ColumnOrName, query: str | None) -> Column:
    """F7. Literal substring without regard to case; an empty query matches every row."""
    return F.contains(F.lower(col(name)), F.lower(F.lit(query))) if query else F.lit(True)


def in_category(category: ColumnOrName, wanted: str) -> Column:
    """F8."""
    return F.lit(True) if wanted == ANY else col(category) == wanted


def has_status(is_active: ColumnOrName, wanted: str) -> Column:
    """F8. ``All``, ``Active`` or ``Inactive``."""
    if wanted == ANY:
        return F.lit(True)
    active = F.coalesce(col(is_active), F.lit(False))
    return active if wanted == ACTIVE else ~active


def low_stock(status: ColumnOrName = "status") -> Column:
    """F12."""
    return col(status) == LOW_STOCK


def filled(text: ColumnOrName) -> Column:
    """F13/F14. Text that is there; false, not NULL, where it is missing."""
    return F.coalesce(col(text) != "", F.lit(False))


def positive(amount: ColumnOrName) -> Column:
    """F14. False, not NULL, where the amount is missing."""
    return F.coalesce(col(amount) > 0, F.lit(False))
