"""Session settings that the plans count on at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes the shuffles, turns a join into a broadcast only on a measured size, and
# splits a join partition that one key fills. "Force" lets it split also where a later join on the
# same key then needs a shuffle of its own.
SETTINGS = {
    # A bad number or a sum out of range fails the job instead of turning into NULL or wrapping round.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # What one task reads of a shuffle. Rows that a shuffle packs into a byte take five and more where they are sorted,
    # and again in each of several sums by keys that hardly repeat: 64 MB became 1.7 GB in a task of the returns.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


# One shuffle task per this many bytes to begin with; adaptive execution merges small ones.
BYTES_PER_TASK = 256 * 1024 * 1024
# Bytes that a query shuffles over all its steps, at most about, by bytes that it reads: a task then begins with 16 MB.
SHUFFLED_PER_READ = 16


def shuffle_tasks(shuffled_bytes: int, least: int = 200) -> int:
    """Number of shuffle partitions to begin with for a shuffle of this size."""
    return max(least, shuffled_bytes // BYTES_PER_TASK)


def input_bytes(df: DataFrame) -> int:
    """Size of the tables that a frame reads, as Spark knows it without running anything."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def tuned(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """The session with ``SETTINGS`` in place.

    ``shuffled_bytes``, the size of what a job reads (``input_bytes``), sets the number of partitions its
    shuffles begin with, at least the cluster's own setting; without it that setting stays.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffled_bytes is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_tasks(shuffled_bytes, least))
        )
    return spark
