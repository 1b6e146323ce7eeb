import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shopmetrics.llm import near_duplicates as nd
from shopmetrics.llm import toxicity as tx
from shopmetrics.llm.common import BATCH, set_to, ship, written


def test_texts_go_to_python_in_small_batches(spark):
    ship(spark)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [sum(len(t.as_py()) for t in batch.column(0))]})

    sizes = [r["bytes"] for r in texts.mapInArrow(run, "bytes long").collect()]
    assert sum(sizes) == 40 << 20 and max(sizes) <= BATCH + (1 << 20)


def test_staged_frames_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    found, _ = written(rows, "sums")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and found.agg(F.sum("count")).first()[0] == 1000


def test_no_words_are_kept_and_training_fills_one_array():
    known = nd._Hashes()
    nd.shingles(" ".join(f"w{k}" for k in range(5000)).encode(), 2, known)
    assert not hasattr(known, "__len__") and not vars(known)
    texts = [b"", b"a", b"fine words here", b"zgrok bad zgrok", b"x" * 200] * 4
    labels = np.array([0, 0, 0, 1, 0] * 4)
    settings = tx.Settings(epochs_mean=2, epochs_worst=2)
    scores, slope, _ = tx.train(texts, labels, np.ones(20), settings)
    model = tx.Model(scores, slope, 0.0, 0.1, settings)
    assert tx.score_text(b"zgrok bad zgrok", model) > tx.score_text(b"fine words here", model)


def test_few_pairs_go_to_the_texts(spark):
    """A small stored table of pairs does not make the larger one be shuffled."""
    texts, _ = written(spark.range(20_000).select(F.col("id").alias("cls"), F.sha2(F.col("id").cast("string"), 256).alias("text")), "texts")
    pairs, _ = written(spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "a long, b long"), "pairs")
    with set_to(spark, "spark.sql.autoBroadcastJoinThreshold", str(256 << 10)):
        found = nd._asked(texts, pairs)
        assert "BroadcastHashJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
        assert sorted(r["cls"] for r in found.collect()) == [1, 2, 3]
