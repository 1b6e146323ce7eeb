"""Benchmark passages in documents, by the q-gram lemma and banded alignment (operator 9).

A passage of m characters that occurs in a text with at most e edits shares at least m - q + 1 - q * e of its q-grams
with the text, and their diagonals (place in the text less place in the passage) lie within e of each other. So
shared q-grams are counted in overlapping bands of diagonals; regions of a text that reach the bound are aligned
with the passage in a band, which gives the number of edits. Nothing within the budget is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from shopmetrics.llm.common import plainly_named

Q = 7
MASK = np.uint64((1 << 8 * Q) - 1)
#: Sizes (as powers of two) of the tables that say whether a q-gram may be known, and where it probably is.
BITS, SLOTS = 21, 21
#: A q-gram at more places of the benchmark than this is common.
COMMON = 3
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Blanks and ASCII punctuation part words; letters are compared in lower case.
PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Budget:
    """``edits`` per character of a passage. Characters are bytes of the normalised UTF-8 text. Passages of more than
    ``piece`` characters are cut into pieces that count on their own; passages shorter than
    ``shortest`` say too little for edits and must stand there word for word."""

    edits: float = 0.1
    piece: int = 512
    shortest: int = 40
    #: Bytes of benchmark text whose q-grams one pass over the documents looks up.
    block: int = 2_000_000

    def of(self, length: int) -> int:
        """Edits allowed, with at least one shared q-gram left by the lemma."""
        return max(0, min(int(self.edits * length), (length - Q) // Q))

    def pieces(self, text: bytes) -> list[bytes]:
        parts = max(1, -(-len(text) // self.piece))
        step = -(-len(text) // parts) if text else 1
        return [p for k in range(0, len(text), step) if len(p := text[k : k + step]) >= self.shortest]


def normalised(text: str | None) -> bytes:
    """Lower-case words with one blank between them, as UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(PARTED).split()) if text else b""


def codes(text: bytes) -> np.ndarray:
    """The q-gram at each place, as a number."""
    if len(text) < Q:
        return np.empty(0, np.uint64)
    padded = text + b"\0" * 8
    return np.ndarray((len(text) - Q + 1,), "<u8", padded, strides=(1,)) & MASK


class Index:
    """The q-grams of some passages, with the pieces and places that hold them."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.ids, self.pieces = [], []
        #: Short passages by their first word, their number of words and their text.
        self.short: dict[bytes, dict[int, dict[bytes, list[int]]]] = {}
        for item, text in items:
            whole = normalised(text)
            if 0 < len(whole) < budget.shortest:
                words = whole.split(b" ")
                self.short.setdefault(words[0], {}).setdefault(len(words), {}).setdefault(whole, []).append(item)
            for piece in budget.pieces(whole):
                self.ids.append(item)
                self.pieces.append(piece)
        lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.edits = np.array([budget.of(n) for n in lengths], np.int64)
        self.least = lengths - Q + 1 - Q * self.edits
        # A band is two cells of 2 ** shift diagonals, more than the edits: a cell and the next hold all that count.
        self.shift = np.array([int(e).bit_length() for e in self.edits], np.int32)
        found = [codes(p) for p in self.pieces]
        flat = np.concatenate(found) if found else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int32)
        place = (np.concatenate([np.arange(len(f)) for f in found]) if found else np.empty(0)).astype(np.int32)
        # Q-grams that many pieces share are left out of a piece where half its bound remains without them: the bound
        # falls by their number, so the count still misses nothing.
        _, which, many = np.unique(flat, return_inverse=True, return_counts=True)
        common = many[which] > COMMON if len(flat) else np.empty(0, bool)
        left_out = np.bincount(owner[common], minlength=len(found)) if len(flat) else np.zeros(len(found), np.int64)
        spared = 2 * left_out <= self.least
        self.least = np.where(spared, self.least - left_out, self.least)
        kept = ~(common & spared[owner]) if len(flat) else common
        flat, owner, place = flat[kept], owner[kept], place[kept]
        order = np.argsort(flat, kind="stable")
        self.piece, self.place = owner[order], place[order]
        self.code, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.many = self.first.astype(np.int32), self.many.astype(np.int32)
        self.slot = np.zeros(1 << SLOTS, np.int32)
        self.slot[(self.code * MIX) >> np.uint64(64 - SLOTS)] = np.arange(len(self.code))
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.code * MIX) >> np.uint64(64 - BITS)] = True
        self.reach = int((lengths + 2 * self.edits).max()) if len(lengths) else 0

    def _regions(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """Pieces and the parts of a text where they may lie."""
        there = codes(text)
        maybe = np.flatnonzero(self.seen[(there * MIX) >> np.uint64(64 - BITS)])
        there = there[maybe]
        at = self.slot[(there * MIX) >> np.uint64(64 - SLOTS)]
        other = np.flatnonzero(self.code[at] != there)
        at[other] = np.minimum(np.searchsorted(self.code, there[other]), len(self.code) - 1)
        same = self.code[at] == there
        maybe, at = maybe[same].astype(np.int32), at[same]
        many = self.many[at]
        before = np.cumsum(many, dtype=np.int32) - many
        hits = np.arange(many.sum(), dtype=np.int32) + np.repeat(self.first[at] - before, many)
        if not len(hits):
            return
        piece, place = self.piece[hits], self.place[hits]
        # Places before the start of the text have diagonals under zero, by at most the length of a piece.
        cell = (np.repeat(maybe + self.reach, many) - place) >> self.shift[piece]
        span = ((len(text) + self.reach) >> int(self.shift.min())) + 2
        key = piece.astype(np.int64) * span + cell
        if len(self.pieces) * span <= 8 * len(key) + (1 << 16):
            counts = np.bincount(key, minlength=len(self.pieces) * span)
            sums = counts.copy()
            sums[:-1] += counts[1:]
            least = np.repeat(self.least, span)
            keys = np.flatnonzero((sums >= least) & (counts > 0))
        else:
            keys, counts = np.unique(key, return_counts=True)
            following = np.zeros(len(keys), np.int64)
            following[:-1] = np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
            keys = keys[counts + following >= self.least[keys // span]]
        for k in keys:
            p, c = divmod(int(k), span)
            # A place of the passage counts once, however often its q-gram comes back in the band.
            if len(np.unique(place[(key == k) | (key == k + 1)])) >= self.least[p]:
                low = (c << int(self.shift[p])) - self.reach - int(self.edits[p])
                high = low + (2 << int(self.shift[p])) + len(self.pieces[p]) + 2 * int(self.edits[p])
                yield p, max(0, low), min(len(text), high)

    def find(self, text: bytes) -> dict[int, tuple[int, int]]:
        """Per piece within its budget, the edits and the place of its end in the text. The first region counts in
        which it is found; a text is read in overlapping pieces."""
        found: dict[int, tuple[int, int]] = {}
        step = 1 << 14
        for start in range(0, max(1, len(text)) if self.pieces else 0, step):
            part = text[start : start + step + self.reach]
            for p, low, high in self._regions(part):
                if p not in found:
                    region, piece = part[low:high], self.pieces[p]
                    place = region.find(piece)
                    edits, end = (0, place + len(piece)) if place >= 0 else aligned(piece, region, int(self.edits[p]))
                    if edits <= self.edits[p]:
                        found[p] = (edits, start + low + end)
        return found


def _short(index: Index, text: bytes) -> dict[int, int]:
    """Items whose short passage is a run of whole words of the text, and the place where the first one ends."""
    found: dict[int, int] = {}
    if not index.short:
        return found
    words, place = text.split(b" "), 0
    for k, word in enumerate(words):
        for many, passages in index.short.get(word, {}).items():
            run = b" ".join(words[k : k + many])
            for item in passages.get(run, ()):
                found.setdefault(item, place + len(run))
        place += len(word) + 1
    return found


def aligned(piece: bytes, region: bytes, most: int) -> tuple[int, int]:
    """Least edits that turn a part of ``region`` into ``piece``, and where that part ends; ``most + 1`` where it
    takes more than ``most``.

    The region is as wide as the band of diagonals plus the piece, so each row of the alignment keeps only the places
    on the band: from ``i`` to ``i`` plus the difference of the lengths.
    """
    a, b = np.frombuffer(piece, np.uint8), np.frombuffer(region, np.uint8)
    width = max(len(b) - len(a), 0) + 2 * most + 1
    # Column k of row i stands for place i + k - most of the region.
    padded = np.concatenate([np.zeros(most, np.uint8), b, np.zeros(width + most, np.uint8)])
    real = np.concatenate([np.zeros(most, bool), np.ones(len(b), bool), np.zeros(width + most, bool)])
    k = np.arange(width)
    row = np.where((k >= most) & (k <= len(b) + most), 0, most + 1).astype(np.int64)
    for i in range(1, len(a) + 1):
        # The character before place j = i + k - most is region[j - 1].
        window, there = padded[i - 1 : i - 1 + width], real[i - 1 : i - 1 + width]
        straight = row + ~((window == a[i - 1]) & there)
        straight[~there] = most + 1
        down = np.append(row[1:], most + 1) + 1
        now = np.minimum(straight, down)
        now = np.minimum.accumulate(now - k) + k
        now[(k + i - most > len(b)) | (k + i - most < 0)] = most + 1
        row = np.minimum(now, most + 1)
        if row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), len(a) + best - most


def _item_blocks(benchmark: DataFrame, budget: Budget) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of about ``budget.block`` bytes."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // budget.block)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


LEAKS = ArrayType(
    StructType().add("item_id", LongType()).add("edits", IntegerType()).add("end", LongType())
)


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", budget: Budget | None = None, name: str = "leaks"
) -> DataFrame:
    """``docs`` with ``name``, an array of ``item_id, edits, end``: the benchmark passages (or pieces of long ones)
    that occur in the whole text within the budget of edits, by item, each where it is found first; ``end`` is a
    place in the normalised text.

    The benchmark is a set of queries: it is looked up in blocks of bounded size, each in one narrow pass over the
    documents, whose number grows with the benchmark and not with the documents. Null and empty texts have no leaks;
    passages of fewer than ``budget.shortest`` characters are found where they stand as whole words, without edits;
    passages without words and null passages or ids find none; repeated rows are each answered. ``docs`` may not have a column ``name`` yet.
    """
    budget, spark = budget or Budget(), docs.sparkSession
    rows = docs.withColumn(name, F.lit(None).cast(LEAKS))
    at, kind = rows.columns.index(text), rows.schema
    for block in _item_blocks(benchmark, budget):
        shared = spark.sparkContext.broadcast(Index(block, budget))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                before, after = batch.column(batch.num_columns - 1).to_pylist(), []
                for value, known in zip(batch.column(at), before):
                    plain = normalised(value.as_py())
                    found = [(index.ids[p], e, z) for p, (e, z) in index.find(plain).items()]
                    found += [(item, 0, z) for item, z in _short(index, plain).items()]
                    own = [{"item_id": item, "edits": e, "end": z} for item, e, z in found]
                    after.append(sorted([*(known or []), *own], key=lambda x: (x["item_id"], x["end"])))
                column = pa.array(after, batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=batch.schema.names)

        rows = rows.mapInArrow(run, kind)
    return rows.withColumn(name, F.coalesce(name, F.array().cast(LEAKS)))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", budget: Budget | None = None) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, least_edits`` for each row of ``docs``: whether it holds passages
    of the benchmark, which, and the fewest edits of one."""
    found = with_leaks(docs.select("doc_id", F.col(text).alias("text")), benchmark, "text", budget)
    items = F.array_sort(F.array_distinct(F.col("leaks.item_id")))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"),
        items.alias("item_ids"), F.array_min("leaks.edits").alias("least_edits"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", budget: Budget | None = None) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, with their columns, whatever these are named.

    Null and empty texts hold no passage and stay; rows with a null id and repeated rows are each judged by their text.
    An empty benchmark, or one without words, leaves all rows; an empty table gives an empty result.
    """
    names = docs.columns
    found = with_leaks(plainly_named(docs), benchmark, f"c{names.index(text)}", budget, "leaks")
    return found.where(F.size("leaks") == 0).drop("leaks").toDF(*names)
