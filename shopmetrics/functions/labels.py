"""Text labels and status flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmetrics.functions.money import ColumnOrName, col

# Status texts.
LOW_STOCK = "Low Stock"
IN_STOCK = "OK"
ACTIVE = "Active"
INACTIVE = "Inactive"

# Formats of the hour label before and after noon, the label of noon, and of a sale in a list.
MORNING, AFTERNOON, NOON = "%02d:00 AM", "%02d:00 PM", "12:00 PM"
SALE_LABEL = "Sale #%s — %s — %s %s (%s)"


def stock_status(quantity: ColumnOrName, reorder_level: ColumnOrName) -> Column:
    """P7. An unknown quantity counts as ``OK``, as a SQL CASE gives it."""
    return F.when(col(quantity) <= col(reorder_level), LOW_STOCK).otherwise(IN_STOCK)


def active_label(is_active: ColumnOrName) -> Column:
    """P8."""
    return F.when(col(is_active), ACTIVE).otherwise(INACTIVE)


def hour_label(hour: ColumnOrName) -> Column:
    """P11. Twelve-hour label; midnight is written ``00:00 AM``."""
    h = col(hour)
    return (
        F.when(h < 12, F.format_string(MORNING, h))
        .when(h > 12, F.format_string(AFTERNOON, h - 12))
        .when(h == 12, NOON)
    )


def sale_label(sale_id, sale_date, total, cashier, currency: str) -> Column:
    """P20. One line that names a sale in a pick list."""
    parts = [sale_id, sale_date, F.lit(currency), total, cashier]
    return F.format_string(SALE_LABEL, *[col(p).cast("string") for p in parts])


def staff_label(full_name: ColumnOrName, role: ColumnOrName) -> Column:
    """P20. ``name (role)``."""
    return F.concat(col(full_name), F.lit(" ("), col(role), F.lit(")"))


def title_case(c: ColumnOrName) -> Column:
    """P25."""
    return F.initcap(col(c))


def same_text(a: ColumnOrName, b: ColumnOrName) -> Column:
    """P24. Equality without regard to case."""
    return F.lower(col(a)) == F.lower(col(b))


def rand_int(lo: int, hi: int, seed: int, *keys: ColumnOrName) -> Column:
    """P28. Uniform integer in ``lo..hi``, both ends included.

    With ``keys`` the value follows from the row's keys and the seed alone: the same rows get the same values on any
    layout and in any run. Without, it is repeatable for one layout of the data.
    """
    if keys:
        return (F.pmod(F.xxhash64(F.lit(seed), *map(col, keys)), F.lit(hi - lo + 1)) + lo).cast("int")
    return (F.floor(F.rand(seed) * (hi - lo + 1)) + lo).cast("int")


def rand_choice(options: list, seed: int, *keys: ColumnOrName) -> Column:
    """P28. One of ``options``."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), rand_int(1, len(options), seed, *keys))
