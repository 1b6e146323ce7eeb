"""Readers (S1-S7). Every reader declares its schema, so no file is read to guess types."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.dates import as_date
from shopmetrics.sources import schemas


def load_table(
    spark: SparkSession, directory: str, name: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """S1. Parquet table ``<directory>/<name>.parquet``; columns and filters are pruned at the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(os.path.join(directory, f"{name}.parquet"))


def load_by_month(
    spark: SparkSession, path: str, schema: T.StructType, start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> DataFrame:
    """S1 for a table written by ``sinks.write_by_month``; only the months from ``start`` to ``end`` are read."""
    stored = T.StructType([*schema.fields, T.StructField("month", T.StringType())])
    months = spark.read.schema(stored).parquet(path)
    if start is not None:
        months = months.filter(F.col("month") >= as_date(start).strftime("%Y-%m"))
    if end is not None:
        months = months.filter(F.col("month") <= as_date(end).strftime("%Y-%m"))
    return months.drop("month")


def seed_frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """S3. A small literal table."""
    return spark.createDataFrame(rows, schema)


def explode_businesses(df: DataFrame, map_col: str) -> DataFrame:
    """S4. ``map<name, struct<revenue, expenses>>`` to one row per name."""
    return df.select(F.explode(map_col).alias("name", "figures")).select(
        "name", "figures.revenue", "figures.expenses"
    )


def load_sheet(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S5. One exported sheet. Columns go by position; the header text is skipped, not matched.

    A cell that does not parse as its declared type fails the read.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def load_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S7. A record list whose header must name the declared columns, in order."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def load_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, by_name: bool = False
) -> dict[str, DataFrame]:
    """S5 and S7 with refused rows kept: ``rows`` that parse as declared, and ``rejected`` ones.

    ``rejected`` has the declared columns as far as they parse, the ``line`` as it stands in the file, the ``file``, and
    why in ``refused``. ``by_name`` demands that the header names the declared columns, in order.
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    read = (
        spark.read.schema(T.StructType([*declared.fields, T.StructField("_line", T.StringType())]))
        .option("header", True)
        .option("enforceSchema", not by_name)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    # The parser sees only the columns that a query reads, and would miss what does not parse in others: the condition,
    # always true, reads them all.
    every = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in declared.names])) >= 0
    whole = read.withColumn("_bad", F.col("_line").isNotNull() & every)
    rejected = whole.filter("_bad").select(
        *declared.names, F.col("_line").alias("line"), F.col("_file").alias("file"), F.lit("not as declared").alias("refused")
    )
    return {"rows": whole.filter("NOT _bad").select(*declared.names), "rejected": rejected}


def in_file_order(df: DataFrame, name: str = "_row") -> DataFrame:
    """A frame read from files, with a column ``name`` that orders its rows as the files hold them: by file, by the
    split's place in it, and by the row in the split.

    Rows of a task are numbered as they are read, so the order is the same however the files are cut into splits, and
    no shuffle is needed. Use it straight on the read, before any join or shuffle.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias(name))


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """S6. A JSON document with a ``rates`` object, as rows of (base, currency, rate)."""
    doc = spark.read.schema(schemas.RATES).option("multiLine", True).json(path)
    return doc.select("base", F.explode("rates").alias("currency", "rate"))
