"""Ids for new rows (W1, W2, W4, K4): dense, above the highest stored one, and the same when a job runs again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The id of each table whose rows a ledger job adds without one.
ID_OF = {"sale_items": "sale_item_id", "stock_movements": "movement_id", "activity_log": "log_id"}

# Parts are numbered by the upper bits of Spark's row numbers, rows in a part by the lower ones.
_ROW_BITS = 33


def with_ids(new: DataFrame, stored: DataFrame, name: str, by: Sequence[str] | None = None, parts: int = 16) -> DataFrame:
    """``new`` with ids in a column ``name``, in front: the numbers that follow the highest one in ``stored``.

    The rows are dealt to ``parts`` parts by a hash of the columns ``by`` (all, if not given), sorted there by all their
    columns and numbered; the sizes of the parts before give each part its start. Nothing depends on how the rows were
    laid out or on the tasks' order, so a run that is repeated gives each row the same id; with other ``parts`` the ids
    are others. Rows that are equal in all columns get different ids. A column ``name`` of ``new`` is replaced.
    """
    rows = new.drop(name)
    keys = list(by or rows.columns)
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *[c for c in rows.columns if c not in keys])
    placed = dealt.withColumn("_row", F.monotonically_increasing_id())
    part = F.shiftright("_row", _ROW_BITS)
    sizes = placed.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n"))
    # One number per part: a sorted array of a size that the caller sets.
    listed = F.array_sort(F.collect_list(F.struct("part", "n")))
    before = F.map_from_entries(
        F.transform(
            listed,
            lambda p: F.struct(
                p["part"].alias("part"),
                F.aggregate(
                    F.filter(listed, lambda q: q["part"] < p["part"]), F.lit(0).cast("long"), lambda sum_, q: sum_ + q["n"]
                ).alias("before"),
            ),
        )
    )
    starts = sizes.agg(before.alias("starts")).scalar()
    highest = stored.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("highest")).scalar()
    in_part = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    number = highest + F.element_at(starts, part.cast("int")) + in_part + 1
    return placed.select(number.alias(name), *rows.columns)


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a stored table, in its order and types: NULL where ``df`` has none, other columns left out. A
    value that does not fit its type fails the job."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def added_rows(
    outputs: Mapping[str, DataFrame], stored: Mapping[str, DataFrame], schemas: Mapping[str, T.StructType], parts: int = 16
) -> dict[str, DataFrame]:
    """The rows that a ledger job adds to stored tables, ready to be appended: fitted to the tables' schemas, with new
    ids where the job gives none. ``activity`` is the job's name for rows of ``activity_log``."""
    named = {"activity_log" if name == "activity" else name: df for name, df in outputs.items()}
    added = {}
    for name, df in named.items():
        if name in schemas:
            known = ID_OF.get(name)
            if known and known not in df.columns:
                df = with_ids(df, stored[name], known, parts=parts)
            added[name] = fitted(df, schemas[name])
    return added
