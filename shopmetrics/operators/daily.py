"""Sums per day, cashier and payment method, kept up to date batch by batch.

The dashboard's figures are sums over counting sales, so a stored table of daily sums serves them without the sales. A
batch appends its change: the sums of its new sales, and the negative sums of the sales that it voids, however old. The
table is the sum of its changes; ``merged`` works it out and is also how it is compacted. With ``batches.publish`` the
change is published together with the sales it comes from, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.predicates import filled, not_voided

KEYS = ("sale_date", "cashier_id", "payment_method")
#: ``txns`` counts the sales, ``priced`` those with an amount, which ``total`` sums up.
DAILY_SUMS = (
    T.StructType()
    .add("sale_date", T.DateType())
    .add("cashier_id", T.LongType())
    .add("payment_method", T.StringType())
    .add("total", T.DecimalType(28, 2))
    .add("txns", T.LongType())
    .add("priced", T.LongType())
)


def with_figures(sales: DataFrame) -> DataFrame:
    """What daily sums sum up, per sale."""
    return sales.withColumns(
        {"total": F.col("total_amount"), "txns": F.lit(1), "priced": F.when(F.col("total_amount").isNotNull(), 1)}
    )


def _summed(rows: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("total"), F.lit(0))
    sums = rows.groupBy(*KEYS).agg(
        total.alias("total"), F.sum("txns").alias("txns"), F.coalesce(F.sum("priced"), F.lit(0)).alias("priced")
    )
    return sums.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DAILY_SUMS])


def daily_sums(sales: DataFrame) -> DataFrame:
    """The sums of the sales that count."""
    return _summed(with_figures(sales.filter(not_voided())))


def voided_sums(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """What ``ledger.void_sales`` takes away, as negative sums. ``sales`` is the table before the requests.

    A sale that several requests name is taken away once; one that is voided already is not, nor one without a reason.
    """
    named = requests.filter(filled("reason")).select("sale_id").distinct()
    hit = sales.filter(not_voided()).join(named, "sale_id", "left_semi")
    return _summed(with_figures(hit)).withColumns({c: (-F.col(c)).cast(DAILY_SUMS[c].dataType) for c in ("total", "txns", "priced")})


def change(new: DataFrame, sales: DataFrame, requests: DataFrame) -> DataFrame:
    """What a batch changes: its ``new`` sales, less those of the stored ``sales`` and of its own that it voids.

    Of ``sales`` only the voided ones are summed, found by a semi-join with the requests; a request may name a sale of
    the same batch. An empty batch gives no rows.
    """
    columns = ["sale_id", *KEYS, "total_amount", "is_voided"]
    return daily_sums(new).union(voided_sums(sales.select(columns).union(new.select(columns)), requests))


def merged(changes: DataFrame) -> DataFrame:
    """The sums that the changes come to, in any order: what ``daily_sums`` gives of the sales as they are now.

    A group that no counting sale is left in has no row.
    """
    return _summed(changes).filter(F.col("txns") != 0)
