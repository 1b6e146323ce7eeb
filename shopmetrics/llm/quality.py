"""Quality of documents by a classifier and hierarchical empirical Bayes over hosts and paths (operator 10).

A logistic classifier on the make-up of a text gives each document's own evidence. Its mean over a host, and over a
path of the host, says what else to expect there; few documents say little, so a path's mean is shrunk toward its
host's and a host's toward the global one, by the ratio of the spread within to the spread between, as the data show
it. A document's log odds move by what its path, without itself, has over the global mean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import held_out, looked_up, one_per_id, splitting, staged

FEATURES = 12
UPPER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
STOP = np.isin(np.arange(256), np.frombuffer(b".,;:'\"-", np.uint8))
OTHER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)]) & ~BLANK & ~STOP


@dataclass(frozen=True)
class Quality:
    #: Labelled rows that the classifier is fitted on, at most; all else covers all rows and whole texts.
    fitted: int = 8_000
    ridge: float = 1.0
    rounds: int = 30
    threshold: float = 0.5
    #: Sites are never taken to say more than this many documents' own evidence.
    strongest: float = 1.0


def features(text: bytes | None) -> np.ndarray:
    """Shares of kinds of characters, words and lines of a whole text."""
    out = np.zeros(FEATURES)
    words = text.split() if text else []
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    kinds = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    lengths = size - counts[BLANK].sum()
    out[:] = (
        1.0, np.log1p(n) / 5, counts[UPPER].sum() / size * 5, counts[DIGIT].sum() / size * 10, counts[STOP].sum() / size * 10,
        min(counts[OTHER].sum() / size * 10, 5), len(kinds) / n, kinds.most_common(1)[0][1] / n, lengths / n / 10,
        len(set(lines)) / len(lines), min(n / len(lines) / 50, 5), counts[ord("|")] / n,
    )
    return out


def _weights(x: np.ndarray, y: np.ndarray, q: Quality) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first feature is the level."""
    at, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], q.ridge)
    shrink[0] = 1e-3
    for _ in range(q.rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, x.T @ (p - y) + shrink * at)
        at = at - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return at


def fit(docs: DataFrame, labels: DataFrame, q: Quality) -> tuple[np.ndarray, float]:
    """Weights from labelled rows that are not held out, and the share of label 1 (for texts without words).

    The sample is the ``fitted`` labelled ids that come first by hash, trained on in one task. Labels other than 0 and
    1 don't count; of several labels of a document the greatest does. Without both classes the weights are null.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality"), F.count("*")).first()
    prior = ((share[0] or 0) * share[1] + 1) / (share[1] + 2)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(q.fitted)  # at most ``fitted`` ids
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    sample = one_per_id(own).join(F.broadcast(chosen), "doc_id")  # and one row of each

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        x = np.stack([features(t) for t in group.column("text").to_pylist()])
        y = group.column("quality").to_numpy().astype(float)
        rows = [_weights(x, y, q).tobytes()] if 0 < y.mean() < 1 else []
        return pa.table({"weights": pa.array(rows, pa.binary())})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "weights binary").collect()
    return (np.frombuffer(found[0]["weights"], np.float64) if found else None), float(prior)


def _evidence(docs: DataFrame, weights: np.ndarray | None, prior: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = []
            for text in batch.column(3):
                x = features(text.as_py())
                z = float(x @ weights) if weights is not None and x[0] else np.log(prior / (1 - prior))
                chances.append(1 / (1 + np.exp(-np.clip(z, -20, 20))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chances, pa.float64())], names=["doc_id", "host", "path", "chance"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "host", "path", F.col("text").cast("binary")).mapInArrow(
        run, f"doc_id {kind}, host string, path string, chance double"
    )


def _shrinkage(groups: DataFrame, within: float) -> float:
    """How many documents the level above is worth to a group: the spread within over the spread between groups.
    ``groups`` has ``n``, ``mean`` and ``above``, the mean of the level above."""
    row = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("groups"),
        F.sum(F.col("n") * (F.col("mean") - F.col("above")) ** 2).alias("spread"),
    ).first()
    if not row["n"]:
        return 1.0
    room = row["n"] - row["squares"] / row["n"]
    between = max(0.0, (row["spread"] - (row["groups"] - 1) * within) / room) if room > 0 else 0.0
    return within / between if between > within * 1e-6 else 1e6


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", settings: Quality | None = None
) -> DataFrame:
    """``doc_id, held_out, classifier, host_mean, path_mean, score, kept`` for each row of ``docs``.

    ``classifier`` is the chance that the label ``quality`` is 1 by the text alone; ``host_mean`` and ``path_mean`` are
    the shrunken means of the row's site, ``path_mean`` without the row itself; ``score`` combines them and ``kept``
    is whether it reaches the threshold. Null hosts and paths are a host and a path of their own. A text that is null,
    empty or without words has the share of label 1 as its chance. Rows that repeat are rows of their own. Other
    columns, of any name, are not read. An empty table gives an empty result.
    """
    q = settings or Quality()
    with splitting(docs.sparkSession):
        thin = docs.select(
            "doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
            F.col(text).alias("text"),
        )
        rows = staged(_evidence(thin, *fit(thin, labels, q)), "evidence")
        paths = staged(
            rows.groupBy("host", "path").agg(
                F.count("*").alias("n"), F.sum("chance").alias("sum"), F.sum(F.col("chance") * F.col("chance")).alias("squares")
            ),
            "paths",
        )
        total = paths.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum(F.col("squares") - F.col("sum") ** 2 / F.col("n")).alias("within")).first()
        overall = (total["sum"] or 0.5) / (total["n"] or 1)
        within = max((total["within"] or 0.0) / (total["n"] or 1), 1e-9)
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        hosts = hosts.select("host", "n", (F.col("sum") / F.col("n")).alias("mean"), F.lit(overall).alias("above"))
        weight = _shrinkage(hosts, within)
        shrunk = (F.col("n") * F.col("mean") + weight * F.col("above")) / (F.col("n") + weight)
        hosts = staged(hosts.select("host", shrunk.alias("host_mean")), "hosts")
        sites = looked_up(paths, hosts, ["host"])
        own_weight = _shrinkage(sites.select("n", (F.col("sum") / F.col("n")).alias("mean"), F.col("host_mean").alias("above")), within)
        found = looked_up(rows, sites.select("host", "path", "n", "sum", "host_mean"), ["host", "path"])
        others = (F.col("sum") - F.col("chance") + own_weight * F.col("host_mean")) / (F.col("n") - 1 + own_weight)
        bounded = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
        found = found.withColumn("path_mean", bounded(others))
        move = _odds(F.col("path_mean")) - _odds(bounded(F.lit(overall)))
        score = 1 / (1 + F.exp(-(_odds(bounded(F.col("chance"))) + q.strongest * move)))
        return found.select(
            "doc_id", held_out("doc_id").alias("held_out"), F.col("chance").alias("classifier"), "host_mean", "path_mean",
            score.alias("score"), (score >= q.threshold).alias("kept"),
        )
