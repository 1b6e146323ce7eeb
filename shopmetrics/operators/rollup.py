"""Sums through a lookup, one-row frames side by side, and cart merging.

Facts are summed per foreign key *before* the key is looked up. The partial sums of each task
shrink a hot key to one row per task, so neither the shuffle nor the join that follows sees the
key's share of the facts, whatever that share is. No join here carries a broadcast hint: Spark
broadcasts a side whose measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
shuffles both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.money import as_total, line_total


def summed(columns: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def sums_per_key(
    facts: DataFrame, key: str, dim: DataFrame, dim_key: str, names: Sequence[str],
    sums: Sequence[str], by: Sequence[str] = (),
) -> DataFrame:
    """``sums`` per (``key``, ``by``), inner-joined to the ``names`` columns of ``dim``.

    One row per key: several keys may share a name. Keys not in ``dim`` drop out.
    """
    per_key = facts.groupBy(key, *by).agg(*summed(sums))
    lookup = dim.select(F.col(dim_key).alias(key), *names)
    return per_key.join(lookup, key)


def sums_by_name(
    facts: DataFrame, key: str, dim: DataFrame, dim_key: str, names: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """``sums`` per ``names``: entities that share a name merge."""
    return sums_per_key(facts, key, dim, dim_key, names, sums).groupBy(*names).agg(*summed(sums))


def joined_in_splits(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join of rows that may share a key with a frame that has one row per key.

    Adaptive execution can split a hot key only where both sides come straight from a shuffle. If
    ``one`` was summed up by the same keys, Spark would leave its shuffle out; a hash of the keys as
    one more join key makes it shuffle again. A stored table is shuffled once in either case.
    """
    kinds = [_common_type(many.schema[k].dataType, one.schema[k].dataType) for k in keys]
    tag = F.hash(*[F.col(k) if kind is None else F.col(k).cast(kind) for k, kind in zip(keys, kinds)])
    return (
        many.withColumn("_tag", tag).join(one.withColumn("_tag", tag), [*keys, "_tag"], how).drop("_tag")
    )


def _common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The type under which keys of two types hash alike where they are equal; None if the types are the same."""
    if left == right:
        return None
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    return T.DoubleType() if isinstance(left, T.NumericType) and isinstance(right, T.NumericType) else T.StringType()


#: Columns of an order, each with whether it descends. Nulls come last in a descending column, first in another.
Order = Sequence[tuple[str, bool]]


def in_order(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def _not_after(order: Order, bound: Column) -> Column:
    """Rows that come no later in the order than the row ``bound``, a struct of the order's columns."""
    upto = F.lit(True)
    for name, down in reversed(order):
        own, last = F.col(name), bound[name]
        if down:
            before = (own > last) | (own.isNotNull() & last.isNull())
        else:
            before = (own < last) | (own.isNull() & last.isNotNull())
        upto = F.coalesce(before, F.lit(False)) | (own.eqNullSafe(last) & upto)
    return upto


def newest(facts: DataFrame, order: Order, known: dict[str, DataFrame], k: int) -> DataFrame:
    """The first ``k`` rows of ``facts`` in an order, of those whose columns in ``known`` are ids of the frames there.

    A first pass takes only the order's columns and the ids through the joins, and finds the ``k``-th row's place in the
    order. A second pass reads the other columns, texts among them, of the rows up to that place. No column needs to be
    unique or filled: rows that tie at the place are cut by their other columns, so there are never more than ``k``,
    and always the same. Each task keeps at most ``k`` rows, however many tie.
    """

    def of_known(rows: DataFrame) -> DataFrame:
        for column, ids in known.items():
            rows = rows.join(ids.toDF(column), column, "left_semi")
        return rows

    names = [c for c, _ in order]
    first = of_known(facts.select(*dict.fromkeys([*names, *known]))).orderBy(*in_order(order)).limit(k)
    backwards = [F.asc_nulls_first(c) if down else F.desc_nulls_last(c) for c, down in order]
    bound = first.orderBy(*backwards).limit(1).select(F.struct(*names)).scalar()
    rest = [(c, False) for c in facts.columns if c not in names]
    upto = of_known(facts.filter(_not_after(order, bound))).select(*facts.columns)
    return upto.orderBy(*in_order([*order, *rest])).limit(k)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as a single row: a union of few rows, never a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def merge_cart_lines(lines: DataFrame) -> DataFrame:
    """A23. One line per product and cart: quantities add up, the first unit price stays.

    Takes ``cart_id, product_id, line_no, quantity, unit_price``; gives
    ``cart_id, product_id, quantity, unit_price, subtotal``. Line numbers are unique in a cart.
    """
    merged = lines.groupBy("cart_id", "product_id").agg(
        F.sum("quantity").cast(lines.schema["quantity"].dataType).alias("quantity"),
        F.min_by("unit_price", "line_no").alias("unit_price"),
    )
    return merged.withColumn("subtotal", as_total(line_total("quantity", "unit_price")))


def cart_totals(merged: DataFrame) -> DataFrame:
    """A23. Subtotal per cart."""
    return merged.groupBy("cart_id").agg(as_total(F.sum("subtotal")).alias("subtotal"))
