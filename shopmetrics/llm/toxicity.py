"""Toxicity by subword-bag embeddings under a linear softmax (operator 3).

A text is the bag of the character n-grams of its words, ends marked by blanks; short words are n-grams themselves.
Each n-gram is hashed to a bucket with an embedding, a passage is the mean of its n-grams' embeddings, and a linear
softmax over it gives the odds. Embeddings and softmax are trained together in numpy, so a misspelling never seen
takes the vectors of the n-grams it shares. A document is as toxic as its worst passage: a few words must not drown
in a long text.

With two classes the loss depends on the embeddings only through each bucket's difference of scores, so a pass
over the sample gathers one number per n-gram, and the gradient of an embedding is a number times the softmax's
difference of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from shopmetrics.llm.common import held_out, one_per_id, plainly_named

#: Bytes of a cell; two neighbouring cells are a passage.
CELL = 16
BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


@dataclass(frozen=True)
class Settings:
    """``toxic_rows`` and ``clean_rows`` bound the labelled sample that the classifier is fitted on; everything else
    covers all rows and whole texts."""

    toxic_rows: int = 900
    clean_rows: int = 2_400
    bits: int = 17
    dims: int = 8
    shortest: int = 3
    longest: int = 6
    epochs_mean: int = 10
    epochs_worst: int = 40
    rate: float = 1.0
    threshold: float = 0.3
    seed: int = 7


def grams(text: bytes, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the bucket of the n-gram at each byte and whether there is one (1 or 0): it lies in one word,
    with the blanks at the word's ends."""
    at = np.frombuffer(b" " + text.translate(BLANKED) + b" " * s.longest, np.uint8)
    size = len(at) - s.longest + 1
    letter, rolled, inside = (at != 32).view(np.uint8), at[:size].astype(np.uint32), np.ones(size, np.uint8)
    for n in range(2, s.longest + 1):
        rolled *= np.uint32(0x01000193)
        rolled += at[n - 1 : n - 1 + size]
        if n > 2:
            inside = inside & letter[n - 2 : n - 2 + size]
        if n >= s.shortest:
            mixed = rolled >> np.uint32(15)
            mixed ^= rolled
            mixed *= np.uint32(0x9E3779B1 + 2 * n)
            mixed >>= np.uint32(32 - s.bits)
            yield mixed, inside


def _cells(values: np.ndarray) -> np.ndarray:
    return np.pad(values, (0, -len(values) % CELL)).reshape(-1, CELL)


def _passages(values: np.ndarray) -> np.ndarray:
    """Sums over each cell and the next; a lone cell is a passage."""
    cells = np.add.reduceat(values, np.arange(0, len(values), CELL), dtype=np.float32)
    return cells[:-1] + cells[1:] if len(cells) > 1 else cells


def worst_passage(text: bytes | None, per_bucket: np.ndarray, s: Settings) -> float | None:
    """Greatest mean score of a passage, or None for a text without words. Long texts go in overlapping pieces."""
    worst = None
    for start in range(0, len(text or b""), 1 << 16):
        sums = counts = None
        for bucket, inside in grams(text[start : start + (1 << 16) + 2 * CELL], s):
            value = per_bucket.take(bucket)
            value *= inside
            sums = value if sums is None else np.add(sums, value, out=sums)
            counts = inside.copy() if counts is None else np.add(counts, inside, out=counts)
        sums, counts = _passages(sums), _passages(counts)
        if counts.any():
            sums[counts == 0] = -np.inf
            top = float((sums / np.maximum(counts, 1)).max())
            worst = top if worst is None else max(worst, top)
    return worst


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, s: Settings) -> tuple[np.ndarray, float, float]:
    """The difference of the two classes' scores per bucket, and the line that makes a document's worst passage
    the log odds of label 1."""
    none = 1 << s.bits  # the bucket of no n-gram
    sizes = np.array([-(-(len(text) + 2) // CELL) for text in texts])
    # Filled in place: so many small arrays would leave the worker large after the fit.
    cells, start = np.empty((sizes.sum(), CELL * (s.longest - s.shortest + 1)), np.int32), 0
    for text, size in zip(texts, sizes):
        for k, (bucket, inside) in enumerate(grams(text, s)):
            found = np.where(inside > 0, bucket.astype(np.int32), none) + 1
            cells[start : start + size, k * CELL : (k + 1) * CELL] = _cells(found) - 1
        start += size
    cells[cells < 0] = none
    counts = (cells != none).sum(axis=1).astype(np.float32)
    begins = np.cumsum(sizes) - sizes
    lone = sizes == 1
    # A passage is a cell and the next of its document; of a lone cell, the cell and none.
    left = np.concatenate([np.arange(b, b + max(1, n - 1)) for b, n in zip(begins, sizes)])
    owner = np.repeat(np.arange(len(sizes)), np.maximum(1, sizes - 1))
    second = (~lone[owner]).astype(np.float32)
    right = np.where(lone[owner], left, left + 1)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    total = np.maximum(counts[left] + counts[right] * second, 1)
    per_doc = np.maximum(np.add.reduceat(counts, begins), 1)
    y, w = labels.astype(np.float32), (weights / weights.sum()).astype(np.float32)
    balance = np.where(y == 1, 0.5 / max(w[y == 1].sum(), 1e-9), 0.5 / max(w[y == 0].sum(), 1e-9)) * w

    pick = np.random.default_rng(s.seed)
    table = pick.uniform(-0.1 / s.dims, 0.1 / s.dims, (none + 1, s.dims)).astype(np.float32)
    table[none] = 0
    soft, bias = pick.normal(0, 0.5, (s.dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    speed = [np.zeros_like(x) for x in (table, soft, bias)]

    def margins() -> np.ndarray:
        """Of each passage, without the bias."""
        per_bucket = table @ (soft[:, 1] - soft[:, 0])
        sums = np.empty(len(cells), np.float32)
        for start in range(0, len(cells), 1 << 16):
            sums[start : start + (1 << 16)] = per_bucket[cells[start : start + (1 << 16)]].sum(axis=1)
        return (sums[left] + sums[right] * second) / total, sums

    epochs = s.epochs_mean + s.epochs_worst
    for epoch in range(epochs):
        passage, sums = margins()
        if epoch < s.epochs_mean:
            margin = np.add.reduceat(sums, begins) / per_doc
        else:
            top = np.maximum.reduceat(passage, first)
            hits = np.flatnonzero(passage == top[owner])
            worst, margin = hits[np.unique(owner[hits], return_index=True)[1]], top
        chance = 1 / (1 + np.exp(-np.clip(margin + bias[1] - bias[0], -60, 60)))
        wrong = ((chance - y) * balance).astype(np.float32)
        if epoch < s.epochs_mean:
            share = np.repeat(wrong / per_doc, sizes)
            pulled = np.zeros(none + 1)
            for start in range(0, len(cells), 1 << 16):
                part = cells[start : start + (1 << 16)]
                pulled += np.bincount(part.ravel(), np.repeat(share[start : start + (1 << 16)], part.shape[1]), none + 1)
        else:
            share = wrong / total[worst]
            pulled = np.zeros(none + 1)
            for side, factor in ((left, np.ones_like(second)), (right, second)):
                part = cells[side[worst]]
                pulled += np.bincount(part.ravel(), np.repeat(share * factor[worst], part.shape[1]), none + 1)
        pulled[none] = 0
        pulled = pulled.astype(np.float32)
        toward = pulled @ table
        steps = (
            pulled[:, None] * (soft[:, 1] - soft[:, 0]), np.stack([-toward, toward], axis=1),
            np.array([-wrong.sum(), wrong.sum()], np.float32),
        )
        rate = s.rate * (1 - 0.8 * epoch / epochs)
        for k, (value, step) in enumerate(zip((table, soft, bias), steps)):
            # Each step is as long as the rate for the entry that moves most: n-grams that are rare move little.
            speed[k] = 0.7 * speed[k] + step * (rate / max(float(np.abs(step).max()), 1e-12))
            value -= speed[k] * (1.0 if k == 0 else 0.1)
    passage, _ = margins()
    slope, level = _line(np.maximum.reduceat(passage, first), y, w)
    return (table @ (soft[:, 1] - soft[:, 0]))[:none].astype(np.float32), slope, level


def _line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, by Newton steps with a little shrinkage."""
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - centre) / spread, np.ones_like(x)], axis=1).astype(np.float64)
    at, shrink = np.zeros(2), np.array([0.1 / len(x), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        curve = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(shrink + 1e-9)
        at -= np.clip(np.linalg.solve(curve, z.T @ (w * (p - y)) + shrink * at), -2, 2)
    return float(at[0] / spread), float(at[1] - at[0] * centre / spread)


@dataclass(frozen=True)
class Model:
    """Scores per bucket, and the line to log odds; ``empty`` is the score of a text without words."""

    per_bucket: np.ndarray
    slope: float
    level: float
    empty: float
    settings: Settings


def score_text(text: bytes | None, model: Model) -> float:
    worst = worst_passage(text, model.per_bucket, model.settings)
    if worst is None:
        return model.empty
    return float(1 / (1 + np.exp(-np.clip(model.slope * worst + model.level, -700, 700))))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", settings: Settings | None = None) -> Model:
    """A model from the labelled rows that are not held out.

    The sample is the ``toxic_rows`` and ``clean_rows`` labelled ids that come first by hash; classes are weighed
    back to their shares among all labelled rows. It is trained in one task, and only the model comes to the driver.
    A document with several labels counts as toxic if any of them says so; labels other than 0 and 1 don't count.
    Without both classes the score is the share of label 1, and near 0 without labels.
    """
    s = settings or Settings()
    known = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = (totals.get(1, 0) + 0.1) / (sum(totals.values()) + 1.0)
    blank = Model(np.zeros(1 << s.bits, np.float32), 0.0, float(np.log(prior / (1 - prior))), prior, s)
    if len(totals) < 2:
        return blank
    chosen = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in ((1, s.toxic_rows), (0, s.clean_rows))
    ]
    # At most toxic_rows + clean_rows ids, and one row of each.
    labelled = F.broadcast(chosen[0].union(chosen[1]))
    own = docs.select("doc_id", F.col(text).alias("text")).join(labelled.select("doc_id"), "doc_id", "left_semi")
    sample = one_per_id(own).join(labelled, "doc_id")

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(
            zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), group.column("toxic").to_pylist()),
            key=lambda r: (r[0], r[1] or ""),
        )
        y = np.array([r[2] for r in rows])
        counts = np.bincount(y, minlength=2)
        if counts.min() == 0 or not any(r[1] for r in rows):
            return pa.table({"scores": pa.array([], pa.binary()), "slope": pa.array([], pa.float64()), "level": pa.array([], pa.float64())})
        weights = np.where(y == 1, totals[1] / counts[1], totals[0] / counts[0])
        scores, slope, level = train([(r[1] or "").encode() for r in rows], y, weights, s)
        return pa.table({"scores": [scores.tobytes()], "slope": [slope], "level": [level]})

    trained = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "scores binary, slope double, level double").collect()
    if not trained:
        return blank
    return Model(np.frombuffer(trained[0]["scores"], np.float32), trained[0]["slope"], trained[0]["level"], prior, s)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, whole texts read once."""
    names = docs.columns
    carried = docs.select(*[F.col(c) for c in names], F.col(text).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_text(t.as_py(), model) for t in batch.column(batch.num_columns - 1)]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*names, name])

    return carried.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    ``score`` is the chance (0 to 1) that the label is 1, from the text alone; ``predicted`` is 1 from
    ``settings.threshold`` on. A null or empty text, or one without words, has the share of label 1 as its score.
    Rows that repeat are scored alike; a null id counts as held out. Other columns, of any name, are not read.
    An empty table gives an empty result.
    """
    s = settings or Settings()
    model = fit(docs, labels, text, s)
    thin = docs.select("doc_id", F.col(text).alias("text"))
    found = _scores_only(thin, model)
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted")
    )


def _scores_only(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_text(t.as_py(), model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, score double")


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their columns, whatever these are named.

    A null or empty text scores as in ``toxicity`` and so stays where the share of label 1 is under the threshold; a null
    id is scored like any other. Repeated rows are judged alike and all stay or go. Without labels, or with labels of
    one kind only, every row has the same score. An empty table gives an empty result.
    """
    s = settings or Settings()
    names, own = docs.columns, "score"
    model = fit(docs, labels, text, s)
    found = scored(plainly_named(docs), model, f"c{names.index(text)}", own)
    return found.where(F.col(own) < s.threshold).drop(own).toDF(*names)
