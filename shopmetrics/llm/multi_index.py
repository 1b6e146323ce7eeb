"""Approximate nearest neighbours by an inverted multi-index (operator 6).

The two halves of a vector are quantised on their own, and the pair of centroids is the vector's cell. A query orders
the centroids of each half by inner product and goes through the pairs in order of their sums with a heap, until the
cells it has passed hold enough vectors. Those are ranked by their exact inner products.

How many vectors are enough is measured: the neighbours of a bounded sample of queries are found by brute force, and
the budget is the least one that reaches the recall asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopmetrics.llm.common import splitting, staged


@dataclass(frozen=True)
class Index:
    neighbours: int = 20
    #: Rows with ids that this divides are queries.
    every: int = 20
    #: Vectors that the centroids are fitted on, at most.
    fitted: int = 20_000
    #: Centroids of a half, at most; fewer where a cell would hold under ``per_cell`` vectors.
    centroids: int = 256
    per_cell: int = 16
    rounds: int = 12
    #: Queries that the budget is measured with, at most, and the recall it must reach on them.
    measured: int = 200
    recall: float = 0.96
    #: Vectors, and queries, that meet in one task.
    block: int = 8_192
    queries: int = 1_024
    seed: int = 3


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _kmeans(points: np.ndarray, k: int, rounds: int, pick: np.random.Generator) -> np.ndarray:
    if not points.shape[1]:  # the second half of vectors with one component
        return np.zeros((1, 0))
    centres = points[np.sort(pick.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [
            ((centres**2).sum(axis=1) - 2 * points[start : start + 4096] @ centres.T).argmin(axis=1)
            for start in range(0, len(points), 4096)
        ]
    )


def cells_of(points: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    cut = halves[0].shape[1]
    return _nearest(points[:, :cut], halves[0]) * len(halves[1]) + _nearest(points[:, cut:], halves[1])


def visited(query: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> Iterator[int]:
    """Cells in the order of the sum of their centroids' inner products with the query, greatest first."""
    cut = halves[0].shape[1]
    first, second = halves[0] @ query[:cut], halves[1] @ query[cut:]
    order = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = (-first[order[0]]).tolist(), (-second[order[1]]).tolist()
    heap, reached = [(a[0] + b[0], 0, 0)], [-1] * len(a)
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(order[0][i]) * len(b) + int(order[1][j])
        reached[i] = j
        # A pair comes up once both pairs before it have.
        if i + 1 < len(a) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] >= j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Which scores may be among the greatest ``keep`` of their row: matrix products of equal vectors may differ in
    their last bits, so near ties stay."""
    if scores.shape[1] <= keep:
        return np.isfinite(scores)
    least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    return np.isfinite(scores) & (scores >= (least - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0))))[:, None])


def _top(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, points: np.ndarray, keep: int) -> tuple:
    """Per query, the best by exact score, ties to the smaller id. Each exact score is a sum in one fixed order."""
    at, of = np.nonzero(_best(scores, keep))
    exact = (queries[at] * points[of]).sum(axis=1)
    order = np.lexsort((ids[of], -exact, at))
    at, of, exact = at[order], of[order], exact[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, "left")
    held = place < keep
    return at[held], of[held], exact[held]


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """``row, vec_id, vector`` of the rows that take part; ``vector`` holds the components as 64-bit numbers."""
    wide = F.col(column).cast("array<double>")
    sane = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", wide.alias("vector")).where(
        F.col("vec_id").isNotNull() & sane & F.exists(wide, lambda x: x != 0)
    )
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1)
            cuts, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
            packed = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["vec_id", "vector"])

    packed = rows.mapInArrow(run, f"vec_id {kind}, vector binary")
    return staged(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _fitted(rows: DataFrame, dims: int, k: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, fitted in one task on the vectors that come first by hash."""
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(index.seed)), "vec_id", "vector").limit(index.fitted).withColumn("one", F.lit(1))
    cut = max(1, dims // 2)

    def run(group: pa.Table) -> pa.Table:
        points = _matrix(group.sort_by([("vec_id", "ascending"), ("vector", "ascending")]).column("vector"), dims)
        pick = np.random.default_rng(index.seed)
        halves = [_kmeans(half, k, index.rounds, pick) for half in (points[:, :cut], points[:, cut:])]
        return pa.table({"half": pa.array([0, 1], pa.int32()), "centres": [h.tobytes() for h in halves]})

    found = chosen.groupBy("one").applyInArrow(run, "half int, centres binary").orderBy("half").collect()
    first, second = (np.frombuffer(r["centres"], np.float64) for r in found)
    return first.reshape(-1, cut), second.reshape(-1, dims - cut) if dims > cut else np.zeros((1, 0))


def _measured(cells: DataFrame, asked: DataFrame, halves: tuple, counts: np.ndarray, dims: int, index: Index) -> int:
    """The least number of vectors that a query must pass for the recall asked for."""
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(index.seed + 1)), "row").limit(index.measured).select("row", "vector").collect()
    if not sample:
        return 0
    own = np.array([r["row"] for r in sample])
    queries = np.stack([np.frombuffer(r["vector"], np.float64) for r in sample])
    keep = index.neighbours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, rows = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            scores = queries @ points.T
            scores[own[:, None] == rows[None, :]] = -np.inf
            at, of, exact = _top(scores, rows, queries, points, keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), batch.column(2).take(pa.array(of)), pa.array(exact), pa.array(rows[of])],
                names=["query", "cell", "score", "row"],
            )

    near = cells.select("vector", "row", "cell").mapInArrow(run, "query long, cell int, score double, row long")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep).select("query", "cell").collect()
    passed = []
    for k, query in enumerate(queries):
        wanted, before = [r["cell"] for r in near if r["query"] == k], {}
        total = 0
        for cell in visited(query, halves):
            before[cell] = total
            total += int(counts[cell])
        passed += [before[cell] + 1 for cell in wanted]
    passed.sort()
    return passed[min(len(passed) - 1, int(np.ceil(index.recall * len(passed))))] if passed else 0


def nearest(vectors: DataFrame, column: str = "embedding", index: Index | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``index.every``, the
    ``index.neighbours`` rows with the greatest inner product that the index finds among all other rows, or all others
    if they are fewer. ``score`` is the inner product of the original vectors in double precision; ties go to the
    smaller id.

    Rows take no part, as queries or candidates, whose id is null or whose vector is null, empty, zero, holds null or
    non-finite components, or has another length than most (of equally many, the smaller). Rows that repeat are rows
    of their own: each is a candidate of the others, and a repeated query has its answers once per row. Other columns,
    of any name, are not read. Without queries the result is empty.

    A hot cell is cut into blocks, and a block's queries into chunks, so no task holds more than ``index.block``
    vectors and about ``index.queries`` queries.
    """
    index, spark = index or Index(), vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    with splitting(spark):
        rows = _usable(vectors, column)
        lengths = rows.groupBy(F.octet_length("vector").alias("bytes")).count()
        common = lengths.orderBy(F.desc("count"), "bytes").first()
        if common is None:
            return spark.createDataFrame([], result)
        dims, total = common["bytes"] // 8, common["count"]
        rows = rows.where(F.octet_length("vector") == common["bytes"])
        k = int(np.clip(2 ** int(np.log2(max(1.0, (total / index.per_cell) ** 0.5))), 2, index.centroids))
        halves = _fitted(rows, dims, k, index)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = cells_of(_matrix(batch.column(1), dims), halves)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["vec_id", "vector", "row", "cell"])

        cells = staged(rows.select("vec_id", "vector", "row").mapInArrow(assign, f"vec_id {kind}, vector binary, row long, cell int"), "cells")
        asked = cells.where(F.col("vec_id") % index.every == 0)
        counts = np.zeros(len(halves[0]) * len(halves[1]), np.int64)
        for r in cells.groupBy("cell").count().collect():  # at most centroids ** 2 numbers
            counts[r["cell"]] = r["count"]
        budget = _measured(cells, asked, halves, counts, dims, index)
        # Cells in a row share a block until it is full; a large cell has several blocks of its own.
        parts = np.maximum(1, -(-counts // index.block))
        blocks = np.zeros(len(counts), np.int64)
        at, fill = 0, 0
        for c in np.flatnonzero(counts):
            if fill and fill + counts[c] > index.block:
                at, fill = at + 1, 0
            blocks[c] = at
            if parts[c] > 1:
                at, fill = at + int(parts[c]), 0
            else:
                fill += counts[c]
        chunks = max(1, -(-asked.count() // index.queries))
        shared = spark.sparkContext.broadcast((halves, counts, parts, blocks))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            halves, counts, parts, blocks = shared.value
            for batch in batches:
                for row, id_, packed in zip(batch.column(0), batch.column(1), batch.column(2)):
                    wanted, held, own = {}, 0, index.neighbours + 1
                    for cell in visited(np.frombuffer(packed.as_py(), np.float64), halves):
                        if held >= budget and held >= own:
                            break
                        held += int(counts[cell])
                        for part in range(int(parts[cell]) if counts[cell] else 0):
                            wanted.setdefault(int(blocks[cell]) + part, []).append(cell)
                    n = len(wanted)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(wanted), pa.int64()), pa.array([row.as_py() % chunks] * n, pa.int64()),
                            pa.array([row.as_py()] * n, pa.int64()), pa.array([id_.as_py()] * n, batch.column(1).type),
                            pa.array([packed.as_py()] * n, pa.binary()), pa.array(list(wanted.values()), pa.list_(pa.int32())),
                        ],
                        names=["block", "chunk", "row", "query_id", "vector", "cells"],
                    )

        queries = asked.select("row", "vec_id", "vector").mapInArrow(
            ask, f"block long, chunk long, row long, query_id {kind}, vector binary, cells array<int>"
        )

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, parts, blocks = shared.value
            for batch in batches:
                cell, row = batch.column(3).to_numpy(), batch.column(2).to_numpy()
                own = blocks[cell] + row % parts[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["vec_id", "vector", "row", "cell", "block"])

        kept = cells.mapInArrow(place, f"vec_id {kind}, vector binary, row long, cell int, block long")
        kept = kept.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        keep = index.neighbours

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"row": pa.array([], pa.int64()), "query_id": right.column("query_id")[:0], "vec_id": left.column("vec_id")[:0], "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return empty
            left = left.combine_chunks()
            points, cell, rows = _matrix(left.column("vector"), dims), left.column("cell").to_numpy(), left.column("row").to_numpy()
            ids, out = left.column("vec_id").to_numpy(), []
            for start in range(0, right.num_rows, 256):
                part = right.slice(start, 256).combine_chunks()
                asking, own = _matrix(part.column("vector"), dims), part.column("row").to_numpy()
                open_cells = np.stack([np.isin(cell, c) for c in part.column("cells").to_pylist()])
                scores = np.where(open_cells & (own[:, None] != rows[None, :]), asking @ points.T, -np.inf)
                at, of, exact = _top(scores, ids, asking, points, keep)
                taken = pa.array(at)
                out.append(
                    pa.table(
                        {
                            "row": part.column("row").take(taken), "query_id": part.column("query_id").take(taken),
                            "vec_id": left.column("vec_id").take(pa.array(of)), "score": pa.array(exact),
                        }
                    )
                )
            return pa.concat_tables([empty, *out])

        found = kept.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(
            meet, f"row long, query_id {kind}, vec_id {kind}, score double"
        )
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return (
            found.withColumn("rank", F.row_number().over(order).cast("int"))
            .where(F.col("rank") <= keep)
            .select("query_id", "rank", "vec_id", "score")
        )
