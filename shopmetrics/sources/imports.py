"""Typed bulk loads."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.dates import excel_date
from shopmetrics.sources.readers import in_file_order, load_sheet
from shopmetrics.sources.schemas import HOTEL


def _conformed(field: T.StructField, source: T.DataType) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        if isinstance(source, T.NumericType):
            return excel_date(c)
        if isinstance(source, T.StringType):  # text is never a date, whatever it looks like
            return F.lit(None).cast("date")
    return c.cast(field.dataType)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """P14. The columns of ``schema``, cast to its types; a bad number fails the job.

    A DATE column takes spreadsheet serials (numeric), dates and timestamps; text becomes NULL.
    """
    return df.select(
        *[_conformed(f, df.schema[f.name].dataType).alias(f.name) for f in schema.fields]
    )


def load_dedup(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """K5. The first row of each key, by ``order``; ``order`` is dropped.

    A plain aggregate, so each task reduces its own rows before the shuffle and a key that holds
    most of the rows arrives as one row per task. Rows with a NULL key are kept as one key.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in (*keys, order)]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns if c != order])


def load_append(df: DataFrame, schema: T.StructType) -> DataFrame:
    """K6. Every row, conformed."""
    return conform(df, schema)


# How each hotel sheet arrives: column order of the export, with the row number in front that
# says which of two rows with the same key came first. Dates are serial numbers.
HOTEL_SHEETS = {
    "rooms": "_row BIGINT, room_number STRING, room_type STRING, floor INT, capacity INT, "
    "price_per_night DOUBLE, status STRING, amenities STRING",
    "bookings": "_row BIGINT, booking_id STRING, guest_name STRING, nationality STRING, room_number STRING, "
    "room_type STRING, check_in DOUBLE, check_out DOUBLE, nights INT, price_per_night DOUBLE, "
    "total_amount DOUBLE, booking_source STRING, payment_method STRING, status STRING",
    "restaurant_revenue": "_row BIGINT, date DOUBLE, meal_type STRING, covers INT, revenue DOUBLE",
    "staff": "_row BIGINT, staff_id STRING, full_name STRING, role STRING, department STRING, "
    "salary DOUBLE, status STRING",
    "expenses": "_row BIGINT, month STRING, category STRING, description STRING, amount DOUBLE",
}
HOTEL_KEYS = {"rooms": "room_number", "bookings": "booking_id", "staff": "staff_id"}


def load_hotel_table(raw: DataFrame, name: str) -> DataFrame:
    """One conformed hotel table from its raw sheet: first row per key, or every row where no key is set."""
    if name not in HOTEL_KEYS:
        return load_append(raw, HOTEL[name])
    columns = [_conformed(f, raw.schema[f.name].dataType).alias(f.name) for f in HOTEL[name].fields]
    return load_dedup(raw.select("_row", *columns), HOTEL_KEYS[name], "_row")


def load_hotel(spark: SparkSession, directory: str, numbered: bool = True) -> dict[str, DataFrame]:
    """W11. The five hotel tables from ``<directory>/<sheet>.csv``. Exports that are not ``numbered`` bring no row
    numbers in front: their rows count in the order of the files."""
    tables = {}
    for name, ddl in HOTEL_SHEETS.items():
        path = os.path.join(directory, f"{name}.csv")
        if numbered:
            raw = load_sheet(spark, path, ddl)
        else:
            raw = in_file_order(load_sheet(spark, path, ddl.removeprefix("_row BIGINT, ")))
        tables[name] = load_hotel_table(raw, name)
    return tables
