"""Amounts, margins, discounts and currency.

Money is exact decimal until a caller casts it for display.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One amount, and a sum of amounts: a group may hold a large part of all rows.
MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(28, 2)
RATE = T.DecimalType(18, 8)

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_money(c: ColumnOrName) -> Column:
    """Exact two-decimal amount. Casting before a sum keeps the sum independent of row order."""
    return col(c).cast(MONEY)


def as_total(c: ColumnOrName) -> Column:
    """Exact two-decimal sum of amounts."""
    return col(c).cast(TOTAL)


def line_total(quantity: ColumnOrName, price: ColumnOrName) -> Column:
    """P1."""
    return col(quantity) * col(price)


def refund_amount(quantity: ColumnOrName, unit_price: ColumnOrName) -> Column:
    """P30. A refund is at the line price: a discount on the sale is not taken off."""
    return as_money(col(quantity) * col(unit_price))


def profit(revenue: ColumnOrName, expenses: ColumnOrName) -> Column:
    """P3."""
    return col(revenue) - col(expenses)


def margin_pct(
    part: ColumnOrName, whole: ColumnOrName, scale: int | None = None, on_zero: float | None = None
) -> Column:
    """P4. ``part`` as a percentage of ``whole``.

    ``scale`` rounds half to even. Without ``on_zero`` a zero ``whole`` gives NULL; with it,
    every ``whole`` that is not positive gives ``on_zero``.
    """
    pct = F.try_divide(col(part), col(whole)) * 100
    if scale is not None:
        pct = F.bround(pct, scale)
    if on_zero is not None:
        pct = F.when(col(whole) > 0, pct).otherwise(F.lit(on_zero))
    return pct


def profit_verdict(p: ColumnOrName) -> Column:
    """P5."""
    return F.when(col(p) > 0, "profit").when(col(p) == 0, "broke even").when(col(p) < 0, "loss")


def margin_band(margin: ColumnOrName) -> Column:
    """P6."""
    # Band limits in percent.
    return F.when(col(margin) >= 20, "green").when(col(margin) >= 10, "orange").otherwise("red")


def discount_amount(subtotal: ColumnOrName, kind: ColumnOrName, value: ColumnOrName) -> Column:
    """P18, first half: the discount, from zero to the subtotal, rounded to the cent as stored.

    ``kind`` is ``fixed`` or ``percent``; anything else, NULL included, means no discount, as does a NULL value.
    """
    subtotal, kind = as_total(subtotal), col(kind)
    value = F.greatest(F.coalesce(col(value), F.lit(0)), F.lit(0))
    percent = as_total(value / 100 * subtotal)
    return F.coalesce(
        F.when(kind == "fixed", F.least(as_total(value), subtotal)).when(
            kind == "percent", F.least(percent, subtotal)
        ),
        F.lit(0).cast(TOTAL),
    )


def discounted_total(subtotal: ColumnOrName, discount: ColumnOrName) -> Column:
    """P18, second half: what the customer pays, floored at zero."""
    return as_total(F.greatest(as_total(subtotal) - as_total(discount), F.lit(0)))


def product_profit(selling: ColumnOrName, cost: ColumnOrName, quantity: ColumnOrName) -> dict[str, Column]:
    """P19. Columns of one product's profit and loss, for ``withColumns``."""
    unit_profit = col(selling) - col(cost)
    return {
        "revenue": as_total(col(selling) * col(quantity)),
        "cost": as_total(col(cost) * col(quantity)),
        "profit": as_total(unit_profit * col(quantity)),
        "margin_pct": margin_pct(unit_profit, selling, scale=2, on_zero=0),
    }


def converted(amount: ColumnOrName, rate: ColumnOrName) -> Column:
    """P17. Amount in another currency, two decimals, half to even."""
    return F.bround(as_money(amount) * col(rate).cast(RATE), 2).cast(MONEY)


def above(average: ColumnOrName, threshold: float) -> Column:
    """P22. Strictly above."""
    return F.coalesce(col(average) > F.lit(threshold), F.lit(False))


def change_from(today: ColumnOrName, yesterday: ColumnOrName) -> Column:
    """P23. NULL when there is nothing to compare with."""
    return F.when(col(yesterday) != 0, col(today) - col(yesterday))


def till_verdict(difference: ColumnOrName) -> Column:
    """P29."""
    d = col(difference)
    return F.when(d == 0, "balanced").when(d > 0, "overage").when(d < 0, "shortage")


def money_text(c: ColumnOrName, currency: str) -> Column:
    """P21. ``GHS 1,234.50``."""
    return F.concat(F.lit(currency + " "), F.format_number(col(c), 2))
