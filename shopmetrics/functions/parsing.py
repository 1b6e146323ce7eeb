"""Guarded number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmetrics.functions.money import ColumnOrName, col

# What a whole number looks like; digits may be grouped with underscores.
WHOLE_NUMBER = r"^\s*[+-]?\d+(_\d+)*\s*$"

INVALID_NUMBER = "invalid number"
EQUAL_OPERANDS = "revenue and expenses are equal"


def safe_int(text: ColumnOrName) -> Column:
    """P16. Whole number, or NULL where the text is not one. Decimals do not count as whole numbers."""
    t = col(text)
    # Looking first is cheaper than a cast that fails: a failed cast raises and catches an error per row.
    return F.when(t.rlike(WHOLE_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))


def safe_ratio(revenue: ColumnOrName, expenses: ColumnOrName) -> Column:
    """P15. ``revenue / (revenue - expenses)`` from text, as a struct of ``value`` and ``error``.

    Exactly one of the two is set: a bad number or equal operands give an error label.
    """
    r, e = safe_int(revenue), safe_int(expenses)
    difference = r.cast("decimal(20,0)") - e.cast("decimal(20,0)")
    error = F.when(r.isNull() | e.isNull(), INVALID_NUMBER).when(r == e, EQUAL_OPERANDS)
    value = F.try_divide(r.cast("double"), difference.cast("double"))
    return F.struct(value.alias("value"), error.alias("error"))
