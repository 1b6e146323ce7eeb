import pytest
from pyspark.sql import functions as F

from shopmetrics.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names the operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        docs = spark.createDataFrame(full, "doc_id long, text string, source string")
        return docs.select(
            "doc_id", "text", "source", F.lit("en").alias("lang"),
            *[F.lit(7).alias(c) for c in ("row", "cls", "node", "score", "key", "mark", "root", "size", "leaks", "_tag")],
        )

    return make
