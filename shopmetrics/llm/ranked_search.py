"""Ranked lexical search by Block-Max MaxScore (operator 12).

Documents are indexed in shards of bounded size. A shard numbers its documents by ascending id and holds, per term, its
postings in compressed blocks; a block tells its last document and what bounds its scores (the largest frequency and the
shortest document in it), so an index needs no figure of the whole corpus and may grow.

A query reads a shard in windows of documents. The bounds of its lists part them: those that together can't lift a
document over the heap's least score are not essential. Only essential lists bring up candidates; of the others, the
block maxima reject candidates before a block is decompressed. The heaps of the shards are merged at the end.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopmetrics.llm.common import looked_up, new_folder, splitting, written

#: Postings of a block, rows of an Arrow batch, and documents that a query looks at together.
BLOCK, ROWS, WINDOW = 64, 20_000, 2048
#: What a task keeps decompressed: postings of windows, and blocks on their own.
KEPT_POSTINGS, KEPT_BLOCKS = 2_000_000, 20_000
NONE = np.empty(0, np.int64)
#: ASCII characters but letters and digits part terms; A-Z are lower-cased.
CUT = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

SCHEMA = (
    "shard long, term binary, many int, last int, most int, least int, places binary, times binary, "
    "ids array<long>, lengths binary, filled long, total long"
)


@dataclass(frozen=True)
class Layout:
    """``shard`` is the bytes of text after which a shard is closed; ``part`` the terms of queries that one task looks
    up in a shard."""

    shard: int = 32 << 20
    part: int = 20_000


def terms(text: bytes) -> list[bytes]:
    """The lower-cased maximal runs of ASCII letters, digits and characters above ASCII."""
    return text.translate(CUT).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, least first; bytes under 128 end a number. Also where each number begins."""
    sizes = 1 + sum((values >> shift > 0).astype(np.int64) for shift in (7, 14, 21, 28))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        there = sizes > k
        more = np.where(sizes[there] > k + 1, 128, 0)
        out[starts[there] + k] = (values[there] >> 7 * k & 127) | more
    return out, starts


def unpacked(data: bytes) -> np.ndarray:
    """The numbers, one at least, that ``packed`` wrote."""
    found = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(found < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    places = np.arange(len(found)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((found & 127) << 7 * places, starts)


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Shard:
    """The documents of a shard until it is closed."""

    def __init__(self):
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.words, self.size = [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms(text)
        self.ids.append(doc_id)
        self.words.append(np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)))
        self.size += len(text) + 64

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        lengths = np.array([len(self.words[k]) for k in order], np.int64)
        head = {
            "shard": shard, "ids": [self.ids[k] for k in order], "lengths": lengths.tobytes(),
            "filled": int((lengths > 0).sum()), "total": int(lengths.sum()),
        }
        yield pa.RecordBatch.from_pylist([head], _arrow_schema())
        documents, words = len(order), np.concatenate([self.words[k] for k in order])
        if not len(words):
            return
        place = np.repeat(np.arange(documents), lengths)
        key, times = np.unique(words.astype(np.int64) * documents + place, return_counts=True)
        term, place = np.divmod(key, documents)
        # A block ends with its list, or when it is full.
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        within = np.arange(len(term)) - np.repeat(begins, np.diff(np.append(begins, len(term))))
        blocks = np.flatnonzero(within % BLOCK == 0)
        many = np.diff(np.append(blocks, len(term)))
        gaps = np.diff(place, prepend=0)
        gaps[blocks] = place[blocks]
        names = pa.array(list(self.known), pa.binary())
        streams = [packed(gaps), packed(times)]
        columns = {
            "shard": pa.array(np.full(len(blocks), shard)), "term": names.take(pa.array(term[blocks])),
            "many": pa.array(many, pa.int32()), "last": pa.array(place[blocks + many - 1], pa.int32()),
            "most": pa.array(np.maximum.reduceat(times, blocks), pa.int32()),
            "least": pa.array(np.minimum.reduceat(lengths[place], blocks), pa.int32()),
            "places": _binary(streams[0][0], streams[0][1][blocks]), "times": _binary(streams[1][0], streams[1][1][blocks]),
        }
        whole = pa.Table.from_arrays(
            [columns[f.name] if f.name in columns else pa.nulls(len(blocks), f.type) for f in _arrow_schema()], schema=_arrow_schema()
        )
        yield from whole.to_batches(max_chunksize=ROWS)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


def write_index(docs: DataFrame, text: str = "text", layout: Layout | None = None) -> str:
    """Index every row of ``docs`` and return the folder of the index, a Parquet table in the shared folder. It is
    written where the documents are read, without a shuffle; a lost task writes its shards again.

    Ids are integers. Rows that repeat an id, or have none, are documents of their own; null and empty texts, and those
    without terms, are documents that no query finds and that no figure counts. Texts of any length are indexed whole; a
    shard holds at least one. Other columns, of any name, are not read. An empty table gives an empty index.
    """
    most = (layout or Layout()).shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, value.as_buffer().to_pybytes() if value.is_valid else b"")
                if shard.size >= most:
                    yield from shard.rows(number)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield from shard.rows(number)

    folder = new_folder(docs.sparkSession, "lexical-index")
    docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary")).mapInArrow(run, SCHEMA).write.parquet(folder)
    return folder


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


class _Lists:
    """The lists of a shard that some queries ask for, and its documents."""

    def __init__(self, group: pa.Table, documents: int, words: int):
        heads = group.column("lengths").is_valid()
        head = group.filter(heads).slice(0, 1).to_pylist()[0]
        self.ids, self.asked = head["ids"], head["asked"]
        lengths = np.frombuffer(head["lengths"], np.int64)
        self.documents, self.words = documents, max(words, 1)
        self.norm = self._norm(lengths)
        lists = group.filter(pc.invert(heads)).sort_by([("term", "ascending"), ("last", "ascending")])
        self.many, self.last, most, least = (lists.column(c).to_numpy() for c in ("many", "last", "most", "least"))
        self.places, self.times = (lists.column(c).to_pylist() for c in ("places", "times"))
        #: No document of a block scores more, for a weight of one.
        self.bound = self._impact(most.astype(np.int64), self._norm(least.astype(np.int64)))
        names = lists.column("term").to_pylist()
        starts = [k for k, t in enumerate(names) if not k or names[k - 1] != t]
        self.range = {names[a]: (a, b) for a, b in zip(starts, [*starts[1:], len(names)])}
        self.highest = {t: int(self.bound[a:b].max()) for t, (a, b) in self.range.items()}
        self.windows: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        self.single: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _norm(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * lengths * self.documents) // self.words

    @staticmethod
    def _impact(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * times // (1000 * times + 8 * norm)

    def _read(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        gaps, times = (unpacked(b"".join(c[first:end])) for c in (self.places, self.times))
        # The first number of a block is a place.
        gaps[np.cumsum(self.many[first : end - 1])] -= self.last[first : end - 1]
        place = np.cumsum(gaps)
        return place, self._impact(times, self.norm[place])

    def window(self, term: bytes, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the blocks that reach into the window from ``low``."""
        if (term, low) not in self.windows:
            if self.held > KEPT_POSTINGS:
                self.windows.clear()
                self.held = 0
            a, b = self.range[term]
            first, end = a + np.searchsorted(self.last[a:b], (low, low + WINDOW - 1))
            read = self._read(first, min(end + 1, b)) if first < b else (NONE, NONE)
            at = slice(*np.searchsorted(read[0], (low, low + WINDOW)))
            self.windows[term, low] = read[0][at], read[1][at]
            self.held += len(read[0])
        return self.windows[term, low]

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.single:
            if len(self.single) >= KEPT_BLOCKS:
                self.single.clear()
            self.single[k] = self._read(k, k + 1)
        return self.single[k]

    def among(self, term: bytes, low: int, candidates: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of the term in some documents of a window, ascending, that ``blocks`` would hold: only these are read."""
        found, end = np.zeros(len(candidates), np.int64), self.range[term][1]
        if (term, low) in self.windows:
            parts = [(self.windows[term, low], slice(None))] if len(self.windows[term, low][0]) else []
        else:
            cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
            parts = [
                (self.block(int(blocks[a])), slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(blocks)]) if blocks[a] < end
            ]
        for (place, impact), own in parts:
            at = np.searchsorted(place, candidates[own])
            at[at == len(place)] = 0
            found[own] = np.where(place[at] == candidates[own], impact[at], 0)
        return found

    def search(self, wanted: list[tuple[bytes, int]], k: int) -> list[tuple[int, int]]:
        """Score and number of the ``k`` best documents for terms with weights; equal scores by number."""
        lists = sorted((weight * self.highest[t], t, weight) for t, weight in wanted if t in self.range and weight > 0)
        together = np.cumsum([b for b, _, _ in lists])
        heap: list[tuple[int, int]] = []
        floor = 0
        for low in range(0, len(self.norm), WINDOW):
            # Later documents lose ties, so a document has to pass the heap's least score.
            essential = int(np.searchsorted(together, floor, "right"))
            if essential == len(lists):
                break
            sums = np.zeros(WINDOW, np.int64)
            for _, term, weight in lists[essential:]:
                place, impact = self.window(term, low)
                sums[place - low] += weight * impact
            candidates = np.flatnonzero(sums)
            if essential:
                scores, room = sums[candidates], int(together[essential - 1])
                near = scores + room > floor
                candidates, scores = candidates[near], scores[near]
                others = lists[:essential][::-1] if len(candidates) else []
                blocks, bounds = [], []
                for _, term, weight in others:
                    a, b = self.range[term]
                    at = a + np.searchsorted(self.last[a:b], candidates + low)
                    blocks.append(at)
                    bounds.append(weight * np.append(self.bound[a:b], 0)[at - a])
                bound = scores + sum(bounds)
                for j, (_, term, weight) in enumerate(others):
                    near = bound > floor
                    if not near.all():
                        candidates, scores, bound = candidates[near], scores[near], bound[near]
                        blocks, bounds = [x[near] for x in blocks], [x[near] for x in bounds]
                    if not len(candidates):
                        break
                    real = weight * self.among(term, low, candidates + low, blocks[j])
                    scores, bound = scores + real, bound + real - bounds[j]
                sums[candidates] = scores
            for place in candidates[sums[candidates] > floor].tolist():
                score = int(sums[place])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -place - low))
                elif score > heap[0][0]:
                    heapq.heapreplace(heap, (score, -place - low))
            floor = heap[0][0] if len(heap) == k else 0
        return [(score, -place) for score, place in heap]


def _asked(queries: DataFrame, text: str) -> DataFrame:
    """``query, item_id, term, times``: the terms of each row, with how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(v.as_buffer().to_pybytes())) if v.is_valid else Counter() for v in batch.column(2)]
            own = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(own), batch.column(1).take(own), pa.array([t for f in found for t in f], pa.binary()),
                    pa.array([n for f in found for n in f.values()], pa.int64()),
                ],
                names=["query", "item_id", "term", "times"],
            )

    kind = queries.schema["item_id"].dataType.simpleString()
    rows = queries.select(F.monotonically_increasing_id(), "item_id", F.col(text).cast("binary"))
    return rows.mapInArrow(run, f"query long, item_id {kind}, term binary, times long")


def search(index: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", layout: Layout | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each row of ``queries`` (``item_id``, ``text``),
    of all documents of the index.

    N counts the documents with a term, L all their terms, n a document's terms, df the documents with a term and tf its
    times in one. A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); the score is the sum over the query's terms,
    repeats included, of w * (10^9 tf div (1000 tf + 8 m)) with m = 25 + (75 n N div L), in 64-bit integers.

    Only scores above 0 count; equal scores rank by ascending id, null last. Null and empty texts, and those whose terms
    no document has, find nothing. Each row is a query of its own, also where rows repeat an ``item_id`` or have none.
    Other columns, of any name, are not read. Empty tables give an empty result.
    """
    layout, spark = layout or Layout(), queries.sparkSession
    with splitting(spark):
        heads, lists = index.where("lengths IS NOT NULL"), index.where("term IS NOT NULL")
        documents, words = heads.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        asked, _ = written(_asked(queries, text), "asked")
        parts = max(1, -(-asked.count() // layout.part))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        frequent = looked_up(lists.select("term", "many"), asked.select("term").distinct(), ["term"])
        weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
        weights, _ = written(
            frequent.groupBy("term").agg(F.sum("many").alias("df")).select("term", weight.alias("weight")), "term-weights"
        )
        known = looked_up(asked, weights, ["term"])
        one = known.groupBy("part", "query", "item_id").agg(
            F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("weight"))).alias("terms")
        )
        # A part holds a bounded number of terms of whole queries, and goes to each shard.
        blocks = one.groupBy("part").agg(F.collect_list(F.struct("query", "item_id", "terms")).alias("asked"))
        heads = heads.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "ids", "lengths")
        heads = looked_up(heads, blocks, ["part"])
        hit = lists.select("shard", "term", "many", "last", "most", "least", "places", "times")
        hit = hit.join(known.select("part", "term").distinct(), "term")
        both = heads.unionByName(hit, allowMissingColumns=True)
        kind = queries.schema["item_id"].dataType.simpleString()

        def run(group: pa.Table) -> pa.Table:
            lists, rows = _Lists(group, documents, words), []
            for query in lists.asked:
                wanted = [(t["term"], t["weight"]) for t in query["terms"]]
                for score, place in lists.search(wanted, k):
                    rows.append((query["query"], query["item_id"], lists.ids[place], score))
            columns = list(zip(*rows)) or [()] * 4
            item = group.schema.field("asked").type.value_type.field("item_id").type
            kinds = [pa.int64(), item, pa.int64(), pa.int64()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "item_id", "doc_id", "score"])

        found = both.groupBy("shard", "part").applyInArrow(run, f"query long, item_id {kind}, doc_id long, score long")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("item_id", "rank", "doc_id", "score")
