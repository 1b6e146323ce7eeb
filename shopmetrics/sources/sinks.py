"""Report outputs (K1-K4). Writers never gather rows into one task: a report is a directory."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """K1. CSV with a header line per part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ordered_csv(df: DataFrame, path: str) -> list[str]:
    """K1 and R19. A sorted frame as CSV files that, one after the other, are one sorted CSV with one header.

    The tasks write their ranges of rows without headers; the header is a file of its own that sorts first. The order
    of the files is stored as ``_order.json``, a name that readers of the folder skip, and returned.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("header", False).csv(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".csv"))
    quoted = ['"' + c.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns]
    order = ["header.csv", *parts]
    for name, text in (("header.csv", ",".join(quoted) + "\n"), ("_order.json", json.dumps(order))):
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
        out.write(bytearray(text.encode()))
        out.close()
    return order


def write_reports(reports: Mapping[str, DataFrame], directory: str, fmt: str = "parquet") -> None:
    """K2. One dataset directory per named report, or per table of a ledger job.

    The next state of a table goes to a new directory: a job cannot replace a table that it reads.
    """
    for name, df in reports.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(os.path.join(directory, name))


@contextlib.contextmanager
def file_sized(spark: SparkSession):
    """While it lasts, rebalanced partitions have the size of a file and not that of a task of ``session.SETTINGS``."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_by_month(df: DataFrame, date_col: str, path: str) -> None:
    """Store a dated table by calendar month, so that period reports read only their months.

    Adaptive rebalancing gathers each month into few files and splits a month too big for one task.
    """
    month = F.date_format(date_col, "yyyy-MM")
    with file_sized(df.sparkSession):
        (
            df.withColumn("month", month)
            .hint("rebalance", "month")
            .write.mode("overwrite")
            .partitionBy("month")
            .parquet(path)
        )


def write_lines_by_month(items: DataFrame, sales: DataFrame, path: str) -> None:
    """Store the lines of sales by the calendar month of their sale, sorted by sale within files.

    A line without a sale, or of a sale without a date, is in the null month. ``readers.load_by_month`` with a day's
    bounds reads the lines of its month, and bounds on the sale id skip row groups within. The rebalanced partitions are
    sorted, so a month too big for one task is sorted part by part.
    """
    dated = sales.select("sale_id", F.date_format("sale_date", "yyyy-MM").alias("month"))
    with file_sized(items.sparkSession):
        (
            items.join(dated, "sale_id", "left")
            .select(*items.columns, "month")
            .hint("rebalance", "month")
            .sortWithinPartitions("month", "sale_id")
            .write.mode("overwrite")
            .partitionBy("month")
            .parquet(path)
        )


def metric_rows(one_row: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """K3. A one-row frame turned into (metric, value) rows, values as text.

    ``labels`` maps each column to the metric name it is shown under.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("metric"), F.col(c).cast("string").alias("value"))
            for c, label in labels.items()
        ]
    )
    return one_row.select(F.inline(pairs))


def append_activity(log: DataFrame, new: DataFrame) -> DataFrame:
    """K4. The log with new rows added; ids not supplied stay NULL."""
    return log.unionByName(new, allowMissingColumns=True)


def append_rows(df: DataFrame, path: str) -> None:
    """K4. Append to a stored table."""
    df.write.mode("append").parquet(path)


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A frame that several outputs share, worked out once, stored as Parquet and read back by its columns.

    ``folder`` is one that every executor can reach, by default that of ``spark.checkpoint.dir``. The
    caller removes what it no longer needs.
    """
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    path = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
