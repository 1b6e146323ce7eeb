"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mix, token shards.

Each stage is a function of (spark, docs, sf_dir) whose result is stored as Parquet and read again as the next one's
documents. Every stage but the last returns the columns of its documents, whatever these are named.

A document without text holds nothing toxic, no near copy and no benchmark passage, and stays until the mix, which takes
none of it: it has no words. Rows with a null id, and rows that repeat an id, are documents of their own. Copies of a
whole row are near duplicates like others: one stays. Empty documents give empty stages and no shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopmetrics.llm.common import new_folder, ship, table
from shopmetrics.llm.decontamination import uncontaminated
from shopmetrics.llm.mixing import resampled
from shopmetrics.llm.near_duplicates import Join, deduplicated
from shopmetrics.llm.queries import TOKENIZER
from shopmetrics.llm.token_shards import Layout, materialise
from shopmetrics.llm.toxicity import clean


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold of toxicity."""
    ship(spark)
    return clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their five-word shingles."""
    ship(spark)
    return deduplicated(docs, join=Join(words=5, percent=80))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship(spark)
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return resampled(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences written to the binary shards, in training order."""
    ship(spark)
    return materialise(docs, Layout(TOKENIZER))[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mix", mixed_sources),
    ("token_shards", token_shards),
]

#: The stages' models, sketches and files have no SQL form; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
