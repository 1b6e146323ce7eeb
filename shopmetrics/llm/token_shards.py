"""Token ids in training order, as binary shards (operator 1).

Documents are cut into tokens and packed, with an end token after each, into sequences of fixed length. A sequence
has an index that follows from where its text begins, a keyed Feistel permutation of the index range gives it its
place, and the shard of a place is a range of places. Each shard is one file of records of fixed size in the order of
their places: a reader goes through it in sequence, and resumes at any global slot by a seek.

An index is the text's byte offset divided by the sequence's length: a token has a byte at least, so no two sequences
share one. The number of bytes is known before anything is cut into tokens, hence texts are cut and moved once. The
indices that no sequence has leave gaps among the places; a slot is the number of sequences at smaller places.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm.common import new_folder, small_batches, written
from shopmetrics.llm.files import Committed, located

#: Fixed value: the word pattern that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Layout:
    #: Vocabulary file: one line per token, its bytes in base 64 and its id. The same path on all machines.
    tokenizer: str
    end_token: int = 50_256
    #: Fills the last sequence of an input partition.
    pad_token: int = 50_256
    #: Tokens of a sequence. A record holds them as little-endian 16-bit numbers.
    length: int = 512
    #: Bytes of a shard, about.
    shard: int = 32 << 20
    key: int = 0x5EED_C0FFEE
    #: Bytes of sequences that a task gathers before it hands them on.
    gathered: int = 32 << 20
    bytes_per_token: float = field(default=2.5)

    @property
    def stride(self) -> int:
        return 2 * self.length


@functools.cache
def _encoder(path: str) -> tiktoken.Encoding:
    filesystem, name = located(path)
    with filesystem.open_input_file(name) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.read().splitlines())}
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _lengths(path: str) -> np.ndarray:
    """Bytes of each token; the end token counts as one."""
    encoder = _encoder(path)
    lengths = np.ones(1 << 16, np.int64)
    for token, rank in encoder._mergeable_ranks.items():
        lengths[rank] = len(token)
    return lengths


def _round(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def permuted(index: np.ndarray, size: int, key: int, turns: int = 6) -> np.ndarray:
    """Places of indices from 0 to ``size - 1``, one to one. The Feistel network permutes the next power of four;
    places outside the range walk on along their cycle until they fall in it."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for turn in range(turns):
            left, right = right, left ^ _round(right, key, turn, mask)
        return (left << half) | right

    place = once(index.astype(np.uint64))
    while (outside := place >= np.uint64(size)).any():
        place[outside] = once(place[outside])
    return place


def _partition_sizes(docs: DataFrame) -> dict[int, int]:
    """Bytes of text of each input partition, an end token counted as one. One number per partition."""
    sizes = docs.select(
        F.spark_partition_id().alias("part"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")
    )
    return {r["part"]: r["bytes"] for r in sizes.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}


def _packed(docs: DataFrame, layout: Layout, sizes: dict[int, int], shards: int) -> DataFrame:
    """Sequences gathered by shard: ``shard, places, docs, tokens`` (of each document in each sequence), ``blob``."""
    ranges = {p: sizes[p] // layout.length + 1 for p in sorted(sizes)}
    total = sum(ranges.values())
    starts = dict(zip(ranges, np.cumsum([0, *ranges.values()]).tolist()))
    shared = docs.sparkSession.sparkContext.broadcast((sizes, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths, (sizes, starts) = _encoder(layout.tokenizer), _lengths(layout.tokenizer), shared.value
        press = zstandard.ZstdCompressor(level=3)
        part, offset, fill, index = None, 0, 0, 0
        current, spans = np.empty(layout.length, np.uint16), []
        done: list[tuple[int, bytes, list]] = []

        def flushed() -> pa.RecordBatch:
            places = permuted(np.array([d[0] for d in done], np.uint64), total, layout.key)
            owner = (places.astype(object) * shards // total).astype(np.int64) if total * shards >= 2**63 else (
                places.astype(np.int64) * shards // total
            )
            rows = {"shard": [], "places": [], "docs": [], "tokens": [], "blob": []}
            for shard in np.unique(owner):
                mine = np.flatnonzero(owner == shard)
                rows["shard"].append(int(shard))
                rows["places"].append([int(places[k]) for k in mine])
                rows["docs"].append([[s[0] for s in done[k][2]] for k in mine])
                rows["tokens"].append([[s[1] for s in done[k][2]] for k in mine])
                rows["blob"].append(press.compress(b"".join(done[k][1] for k in mine)))
            done.clear()
            return pa.RecordBatch.from_pydict(rows, schema=PACKED)

        for batch in batches:
            for own, doc, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                if part is None:
                    part = own.as_py()
                    base = starts[part]
                value, doc = text.as_py() or "", doc.as_py()
                ids = np.append(encoder.encode_to_numpy(value), layout.end_token).astype(np.uint16)
                taken = 0
                while taken < len(ids):
                    if fill == 0:
                        # Every token has a byte at least, so each sequence begins ``length`` bytes or more after the
                        # one before.
                        index = base + offset // layout.length
                    many = min(layout.length - fill, len(ids) - taken)
                    offset += int(lengths[ids[taken : taken + many]].sum())
                    current[fill : fill + many] = ids[taken : taken + many]
                    spans.append((doc, many))
                    fill, taken = fill + many, taken + many
                    if fill == layout.length:
                        done.append((index, current.tobytes(), spans))
                        fill, spans = 0, []
                if len(done) * layout.stride >= layout.gathered:
                    yield flushed()
        if fill:
            current[fill:] = layout.pad_token
            done.append((index, current.tobytes(), spans))
        if part is not None and offset != sizes[part]:
            raise ValueError(f"partition {part} held {sizes[part]} bytes and now {offset}: store the documents first")
        if done:
            yield flushed()

    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return rows.mapInArrow(
        run, "shard long, places array<long>, docs array<array<long>>, tokens array<array<int>>, blob binary"
    )


PACKED = pa.schema(
    [
        ("shard", pa.int64()), ("places", pa.list_(pa.int64())), ("docs", pa.list_(pa.list_(pa.int64()))),
        ("tokens", pa.list_(pa.list_(pa.int32()))), ("blob", pa.binary()),
    ]
)


WRITTEN = pa.schema(
    [
        ("shard", pa.int64()), ("record", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int32())), ("crc", pa.int64()),
    ]
)


def _shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _stored(packed: DataFrame, layout: Layout, folder: str) -> DataFrame:
    """Writes the shards; one row per record."""

    def write(shard: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        blobs, places = [], [p.column(1)[0].values.to_numpy() for p in pieces]
        docs, tokens = (pa.concat_arrays([p.column(c)[0].values for p in pieces]) for c in (2, 3))
        while pieces:
            blobs.append(memoryview(press.decompress(pieces.pop(0).column(4)[0].as_buffer())))
        owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
        at = np.concatenate([np.arange(len(p)) for p in places]) * layout.stride
        order = np.argsort(np.concatenate(places), kind="stable")
        docs, tokens = (spans.take(pa.array(order)) for spans in (docs, tokens))
        many = tokens.value_lengths().to_numpy()
        n_tokens = np.add.reduceat(tokens.flatten().to_numpy(), np.cumsum(many) - many)  # each has a token at least
        out, crc = Committed(folder, _shard_name(shard)), []
        for k, start in zip(owner[order].tolist(), at[order].tolist()):
            record = blobs[k][start : start + layout.stride]
            out.write(record)
            crc.append(zlib.crc32(record))
        out.commit()
        return pa.RecordBatch.from_pydict(
            {
                "shard": [shard] * len(crc), "record": list(range(len(crc))), "n_tokens": pa.array(n_tokens, pa.int32()),
                "doc_ids": docs.cast(WRITTEN.field("doc_ids").type), "doc_tokens": tokens.cast(WRITTEN.field("doc_tokens").type),
                "crc": crc,
            },
            schema=WRITTEN,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces = None, []
        for batch in batches:
            for k, own in enumerate(batch.column(0).to_pylist()):
                if own != shard and pieces:
                    yield write(shard, pieces)
                    pieces = []
                shard = own
                pieces.append(batch.slice(k, 1))
        if pieces:
            yield write(shard, pieces)

    return packed.mapInArrow(
        run, "shard long, record long, n_tokens int, doc_ids array<long>, doc_tokens array<int>, crc long"
    )


def materialise(docs: DataFrame, layout: Layout, text: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the token shards of ``docs`` to ``folder`` (by default a new one in the shared folder). Gives one row per
    sequence, ``slot, shard, record, n_tokens, doc_ids, doc_tokens, crc``, and the folder.

    ``doc_ids`` are the documents with tokens in the sequence in their order, ``doc_tokens`` how many, end tokens
    included. A shard's file holds the records ``record`` = 0, 1 ... of ``layout.stride`` bytes, and slots number all
    records through the shards in order; ``manifest`` beside the shards has their first slots and record counts.

    A null or empty text is an end token alone. Null ids are carried as nulls; repeated rows are each written.
    Other columns, of any name, are not read. An empty table gives no shards and an empty result. ``docs`` is read
    twice and must keep its partitions, as a stored table does; the task fails if they changed.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sizes = _partition_sizes(thin)
    shards = max(1, round(sum(sizes.values()) / layout.bytes_per_token * 2 / layout.shard))
    packed = _packed(thin, layout, sizes, shards).repartition(shards, "shard").sortWithinPartitions("shard")
    with small_batches(spark):
        records, _ = written(_stored(packed, layout, folder), "records")
    counts = {r["shard"]: r["count"] for r in records.groupBy("shard").count().collect()}  # one number per shard
    firsts, slot = [], 0
    for shard in sorted(counts):
        firsts.append((shard, slot, counts[shard], layout.stride))
        slot += counts[shard]
    manifest = spark.createDataFrame(firsts, "shard long, first_slot long, records long, stride int")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")
    slots = records.join(manifest.select("shard", "first_slot"), "shard").select(
        (F.col("first_slot") + F.col("record")).alias("slot"), "shard", "record", "n_tokens", "doc_ids", "doc_tokens", "crc"
    )
    return slots, folder


def read_records(spark: SparkSession, folder: str, first: int, many: int) -> Iterator[np.ndarray]:
    """The sequences of the slots ``first`` to ``first + many - 1``, in order: one seek per shard, then straight on."""
    rows = spark.read.parquet(f"{folder}/manifest").where((F.col("first_slot") + F.col("records") > first) & (F.col("first_slot") < first + many))
    for row in rows.orderBy("first_slot").collect():
        filesystem, path = located(folder)
        skip = max(0, first - row["first_slot"])
        with filesystem.open_input_file(f"{path}/{_shard_name(row['shard'])}") as file:
            file.seek(skip * row["stride"])
            for _ in range(min(row["records"], first + many - row["first_slot"]) - skip):
                yield np.frombuffer(file.read(row["stride"]), "<u2")
