"""Reading, staging and joining that the operators share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: the blank and the controls tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to Python at once.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per application, through Spark's file server. From then on rows go
    to Python in batches of 8 MB at most, or of one row: whole texts would otherwise come 64 MB at once, and be held by
    Spark and by Python together."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    context, package = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_corpus_package", False) or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "corpus_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._corpus_package = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``. Only where it is unset, as in tests, the driver takes
    one of its own for the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not getattr(context, "_corpus_folder", None):
            context._corpus_folder = tempfile.mkdtemp(prefix="corpus-")
        folder = context._corpus_folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame stored as Parquet in the shared folder and read back, and its path. Cuts the lineage: a lost
    executor costs at most the stages since. Nothing runs the frame a second time, so its shuffle files go with it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def looked_up(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of rows that may share a key with a frame of one row per key.

    Adaptive execution can split a hot key only where both sides come straight from a shuffle made for the
    join. A hash of the keys as one more key keeps it so where a side is already laid out by the keys.
    """
    tag = F.hash(*keys)
    return many.withColumn("_tag", tag).join(one.withColumn("_tag", tag), [*keys, "_tag"], how).drop("_tag")


@contextlib.contextmanager
def set_to(spark: SparkSession, key: str, value: str):
    """While it lasts, the session has this setting."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def splitting(spark: SparkSession):
    """While it lasts, joins are cut at hot keys even where the cut costs one more shuffle."""
    return set_to(spark, "spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def small_batches(spark: SparkSession):
    """While it lasts, rows go to Python in batches of ``BATCH`` bytes at most, or of one row, also where nothing was
    shipped."""
    return set_to(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def plainly_named(df: DataFrame) -> DataFrame:
    """The frame with its columns named by their places: a name of any kind, with dots too, may then go through a task."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves remainder 2 by 4. A null id is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def one_per_id(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text``, one row for each id: of several, the one whose text comes first by hash (null last)."""
    first = F.struct(F.col(text).isNull().alias("last"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return docs.groupBy("doc_id").agg(F.min(first).alias("one")).select("doc_id", F.col("one.text").alias("text"))
