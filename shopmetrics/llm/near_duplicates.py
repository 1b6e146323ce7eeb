"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens (operator 5).

Each document becomes the set of its word shingles, and each distinct set a vector of minwise values. Every
tree sends a set down paths: at a node, some positions of the vector are chosen by the node, and the values
there name the children. Sets of similarity s share a child with probability s per position, so paths of three
steps part nearly all sets that are unlike, and independent trees make it unlikely that a linked pair never meets.

Small nodes are compared exhaustively. A large node either holds a few sets apart from one big known group, and
those are compared with all of it in chunks, or it branches again. Candidates pass an estimate, from the vectors or
from samples of the sets (short texts: the whole sets), and are confirmed on the full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import discard, looked_up, splitting, written
from shopmetrics.llm.components import components

LANES = 128
#: A sample holds all hashes of a set of at most so many, and half to all of this number of a larger one.
SAMPLE = 512
#: Sets of up to so many hashes are compared whole, so that their pairs are decided where they meet.
WHOLE = 4096


@dataclass(frozen=True)
class Join:
    """Parameters of the join. Let a pair of similarity s share a path of one step with probability p1 = s, and of k
    more steps with p(k + 1) = s * (1 - (1 - p(k)) ** children); it is missed with probability (1 - p3) ** trees:
    1.2e-5 for s = 0.8 and the numbers below, 8e-7 for 0.85."""

    words: int = 2
    #: Link where 100 * common >= percent * union.
    percent: int = 80
    trees: int = 8
    children: int = 2
    #: Members of a node that are compared in one task; larger nodes branch or are cut in chunks.
    small: int = 2048
    #: Steps of the longest path; beyond it, nodes are compared chunk by chunk.
    depth: int = 7
    #: Standard deviations of the estimate that a candidate may lie under the threshold.
    slack: float = 5.0
    seed: int = 20_240_501

    @property
    def least_equal(self) -> int:
        """Equal lanes of a pair that goes on to the full sets."""
        s = self.percent / 100
        return int(LANES * max(0.0, s - self.slack * (s * (1 - s) / LANES) ** 0.5))

    @property
    def most_apart(self) -> int:
        """Different low bits of the lanes of a pair that goes on to the lanes: lanes that differ have equal low bits
        half of the time."""
        d = (1 - self.percent / 100) / 2
        return int(LANES * min(1.0, d + self.slack * (d * (1 - d) / LANES) ** 0.5)) + 1


class _Hashes:
    """Hash of each word. It is worked out faster than it is looked up, and a corpus has too many words to keep."""

    __getitem__ = staticmethod(xxhash.xxh64_intdigest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, words: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a lower-cased text. A text with fewer
    words is one shingle; none without words."""
    cut = text.lower().split() if text else []
    if not cut:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, cut), np.uint64, len(cut))
    width = min(words, len(cut))
    runs = np.full(len(cut) - width + 1, 1 + width, np.uint64)
    for k in range(width):
        runs = _mix(runs * np.uint64(0x2545F4914F6CDD1D) + hashes[k : len(cut) - width + 1 + k])
    return np.unique(runs)


def _multipliers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng(seed)
    return (
        pick.integers(0, 2**32, (LANES, 1), dtype=np.uint32) | np.uint32(1),
        pick.integers(0, 2**32, (LANES, 1), dtype=np.uint32),
    )


def minwise(full: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least value of the set under each of ``LANES`` hash functions, in pieces of bounded size."""
    folded = (full ^ (full >> np.uint64(32))).astype(np.uint32)
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(folded), 2048):
        piece = folded[None, start : start + 2048] * by[0]
        piece += by[1]
        piece ^= piece >> np.uint32(15)
        piece *= np.uint32(0x2C1B3C6D)
        np.minimum(least, piece.min(axis=1), out=least)
    return least


def _children(nodes: np.ndarray, lanes: np.ndarray, each: int) -> np.ndarray:
    """The nodes that a set goes to from ``nodes``: each node chooses positions, the set's values name the child."""
    paths = []
    for k in range(each):
        chosen = _mix(nodes + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64))
        at = (chosen % np.uint64(LANES)).astype(np.int64)
        paths.append(_mix(chosen ^ _mix(lanes[at].astype(np.uint64) + np.uint64(k + 1))))
    return np.concatenate(paths)


def sample(full: np.ndarray) -> tuple[int, np.ndarray]:
    """The upper halves of the hashes below a limit that follows from the size of the set, and the limit.
    Sets with different limits are compared below the smaller one."""
    limit = 1 << 32
    while len(full) * limit > SAMPLE << 32:
        limit >>= 1
    upper = (full >> np.uint64(32)).astype(np.uint32)
    return limit, upper[: np.searchsorted(upper, limit - 1, "right")]


def carried(full: np.ndarray) -> tuple[int, np.ndarray]:
    """What a set brings to its nodes: the upper halves of all its hashes, or a sample of a large set."""
    return sample(full) if len(full) > WHOLE else (1 << 32, (full >> np.uint64(32)).astype(np.uint32))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, text: str, join: Join) -> DataFrame:
    """Per row of ``docs``: its ``doc_id``, ``mark`` (a hash of the text) and ``n_shingles``, ``digest`` (16 bytes, equal for equal sets),
    ``lanes`` (the vector, 16 bits each), their lowest bits in ``bits_1`` and ``bits_2``, and ``nodes`` (the paths of
    three steps in all trees)."""
    each_tree, by = np.arange(1, join.trees + 1, dtype=np.uint64), _multipliers(join.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            ids, sizes, digests, lanes, nodes, bits = batch.column(0), [], [], [], [], ([], [])
            for value in batch.column(1):
                full = shingles(value.as_py(), join.words, known)
                sizes.append(len(full))
                if not len(full):
                    for column in (digests, lanes, nodes, *bits):
                        column.append(None)
                    continue
                least = minwise(full, by)
                digests.append(xxhash.xxh3_128_digest(full.tobytes()))
                lanes.append(least.astype(np.uint16).tobytes())
                for column, word in zip(bits, np.packbits((least & 1).astype(np.uint8)).view(np.int64).tolist()):
                    column.append(word)
                roots = _mix(each_tree + np.uint64(join.seed))
                at = (roots % np.uint64(LANES)).astype(np.int64)
                first = _mix(roots ^ _mix(least[at].astype(np.uint64)))
                second = _children(first, least, join.children)
                nodes.append(_signed(np.unique(_children(second, least, join.children))))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(lanes, pa.binary()),
                    pa.array(nodes, pa.list_(pa.int64())), *[pa.array(b, pa.int64()) for b in bits],
                ],
                names=["doc_id", "mark", "n_shingles", "digest", "lanes", "nodes", "bits_1", "bits_2"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary"), F.xxhash64(text)).mapInArrow(
        run,
        f"doc_id {kind}, mark long, n_shingles long, digest binary, lanes binary, nodes array<long>, bits_1 long, bits_2 long",
    )


def _equal_lanes(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose vectors agree in ``least`` positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_matrix(batch.column(k)) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).sum(axis=1) >= least))

    return pairs.select("a", "b", "lanes_a", "lanes_b").mapInArrow(run, "a long, b long")


def _matrix(lanes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(lanes.to_pylist()), np.uint16).reshape(-1, LANES)


def _asked(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``facts`` whose classes are in ``pairs``, a stored table. Its size is known, so that where it is small
    it goes to the facts, and these are not shuffled whole in each step for the sake of few pairs."""
    return looked_up(facts, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), ["cls"])


def _estimated(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Pairs near enough by the lowest bits of their lanes, and then by their lanes."""
    for side in ("a", "b"):
        pairs = looked_up(pairs, classes.select("cls", "bits_1", "bits_2").toDF(side, f"{side}_1", f"{side}_2"), [side])
    apart = F.bit_count(F.col("a_1").bitwiseXOR(F.col("b_1"))) + F.bit_count(F.col("a_2").bitwiseXOR(F.col("b_2")))
    pairs, _ = written(pairs.where(apart <= join.most_apart).select("a", "b"), "near-pairs")
    lanes = _asked(classes.select("cls", "lanes"), pairs)
    for side in ("a", "b"):
        pairs = looked_up(pairs, lanes.toDF(side, f"lanes_{side}"), [side])
    return _equal_lanes(pairs, join.least_equal)


def _texts(docs: DataFrame, wanted: DataFrame, text: str, join: Join) -> DataFrame:
    """``cls, text, limit, sample`` of the wanted classes: the text of one of their documents, and its set or sample.

    Texts are shuffled once: the first id of a class and the mark of its text name the class, and copies of that row,
    which share both, are in one place with it."""
    named = docs.select(id_text("doc_id").alias("first"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    asked = wanted.select(id_text("first_id").alias("first"), F.col("first_mark").alias("mark"), "digest", "cls")
    found = named.join(asked, ["first", "mark"]).dropDuplicates(["first", "mark"])
    words = join.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            own = [shingles(t.as_py(), words, known) for t in batch.column(2)]
            same = [xxhash.xxh3_128_digest(x.tobytes()) == d.as_py() for x, d in zip(own, batch.column(1))]
            parts = [carried(full) for full in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([p[0] for p in parts], pa.int64()),
                    pa.array([p[1].tobytes() for p in parts], pa.binary()),
                ],
                names=["cls", "text", "limit", "sample"],
            ).filter(pa.array(same, pa.bool_()))

    return found.select("cls", "digest", "text").mapInArrow(run, "cls long, text binary, limit long, sample binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are as similar as asked for. Texts travel and are cut into
    shingles again: they are shorter than their sets of hashes."""
    words, percent = join.words, join.percent
    pairs, _ = written(pairs, "likely-pairs")
    texts = _asked(texts.select("cls", "text"), pairs)
    for side in ("a", "b"):
        pairs = looked_up(pairs, texts.toDF(side, f"text_{side}"), [side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, recent = _Hashes(), OrderedDict()

        def full(cls: int, value: pa.Scalar) -> np.ndarray:
            if cls not in recent:
                recent[cls] = shingles(value.as_py(), words, known)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[cls]

        for batch in batches:
            linked = []
            for a, b, text_a, text_b in zip(*batch.columns):
                left, right = full(a.as_py(), text_a), full(b.as_py(), text_b)
                common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def unsettled(members: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Members of the nodes that hold sets not known to be connected, with ``label``, whether the label is the
    node's largest (``major``), and the node's counts ``m`` of members and ``r`` of members under other labels.

    A node's pivot has been compared with all its members already, and is left out. Columns ``more`` come along."""
    rest = members.where("cls <> pivot AND n > 2").select("node", "cls", *more)
    labelled = looked_up(rest, labels, ["cls"], "left").withColumn("label", F.coalesce("root", "cls"))
    per_label = labelled.groupBy("node", "label").agg(F.count("*").alias("n"))
    nodes = per_label.groupBy("node").agg(
        F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")
    )
    nodes = nodes.where("labels > 1").select("node", "m", (F.col("m") - F.col("top.n")).alias("r"), "top.label")
    return (
        looked_up(labelled.drop("root"), nodes.withColumnRenamed("label", "top"), ["node"])
        .withColumn("major", F.col("label") == F.col("top"))
        .drop("top")
    )


def _similar(limits: np.ndarray, samples: list[np.ndarray], asks: np.ndarray, join: Join) -> Iterator[tuple]:
    """For each index in ``asks``: it, the indices of the sets whose similarity to it may reach the threshold by their
    samples, within ``join.slack`` standard deviations, and whether each surely reaches it, above by as much. Samples
    that are whole sets miss no common hash, and may count one too many where upper halves of different hashes agree."""
    values, starts = np.concatenate(samples), np.cumsum([0, *map(len, samples)])[:-1]
    ids = np.unique(values, return_inverse=True)[1]
    share = join.percent / 100
    for i in asks:
        own = np.zeros(ids.max() + 1, bool)
        own[ids[starts[i] : starts[i] + len(samples[i])]] = True
        below = values <= np.uint32(limits[i] - 1)
        common = np.add.reduceat((own[ids] & below).astype(np.int64), starts)
        theirs = np.add.reduceat(below.astype(np.int64), starts)
        limit = np.minimum(limits, limits[i])
        union = theirs + np.searchsorted(samples[i], (limit - 1).astype(np.uint32), "right") - common
        whole = limit == 1 << 32
        room = ~whole * join.slack * np.sqrt(share * (1 - share) * union)
        near = np.flatnonzero(common >= share * union - room - 1e-9)
        yield i, near, common[near] - 1 >= share * (union[near] + 1) + room[near]


def chunked(members: DataFrame, small: int, *more: str) -> DataFrame:
    """Groups ``node, part, askers`` in which members outside a node's largest label (``asks``) meet all its members.
    Both sides are cut in chunks of at most about ``small``, so that no task holds a whole node. Columns ``more`` come along."""
    chunk = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.ceil(F.col(n) / small).cast("long")).cast("int")
    pieces = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / small).cast("int") - 1))
    every = members.select(
        "node", F.lit(False).alias("asks"), "cls", "label", *more, chunk("m", 1).alias("part"), pieces("r").alias("askers")
    )
    asking = members.where("NOT major").select(
        "node", F.lit(True).alias("asks"), "cls", "label", *more, pieces("m").alias("part"), chunk("r", 2).alias("askers")
    )
    return every.unionByName(asking)


def _alike(members: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The members that have one of another label near them in their node by the lowest bits of the lanes. Sets that
    came to a node by chance go no further."""
    most = join.most_apart

    def run(group: pa.Table) -> pa.Table:
        label, asks = group.column("label").to_numpy(), group.column("asks").to_numpy()
        bits = [group.column(c).to_numpy() for c in ("bits_1", "bits_2")]
        held = np.zeros(len(label), bool)
        for i in np.flatnonzero(asks):
            apart = sum(np.bitwise_count((b ^ b[i]).view(np.uint64)) for b in bits)
            near = (apart <= most) & ~asks & (label != label[i])
            held |= near
            held[i] = near.any()
        return group.select(["node", "cls"]).filter(pa.array(held))

    rows = looked_up(chunked(members, join.small), classes.select("cls", "bits_1", "bits_2"), ["cls"])
    near = rows.groupBy("node", "part", "askers").applyInArrow(run, "node long, cls long").distinct()
    return looked_up(members, near, ["node", "cls"])


def _compared(members: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """Pairs ``a, b`` of members of one node with different labels whose samples agree enough.

    Members outside a node's largest label meet all its members. Pairs that surely link join their labels, and pairs
    within one joined label are not asked for again.
    """
    rows = looked_up(chunked(members, join.small), texts.select("cls", "limit", "sample"), ["cls"])

    def run(group: pa.Table) -> pa.Table:
        own, label = group.column("cls").to_numpy(), group.column("label").to_numpy()
        asks = group.column("asks").to_numpy()
        samples = [np.frombuffer(x, np.uint32) for x in group.column("sample").to_pylist()]
        found, root = set(), {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for i, near, sure in _similar(group.column("limit").to_numpy(), samples, np.flatnonzero(asks), join):
            other = ~asks[near] & (label[near] != label[i])
            for unsure, j in sorted(zip((~sure[other]).tolist(), near[other].tolist())):
                if (a := find(int(label[i]))) != (b := find(int(label[j]))):
                    found.add((min(own[i], own[j]), max(own[i], own[j])))
                    if not unsure:
                        root[a] = b
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return rows.groupBy("node", "part", "askers").applyInArrow(run, "a long, b long").distinct()


def _branched(members: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The members one step further down their paths. A set's nodes are gathered per set, and are few: at most
    trees * children ** depth."""
    nodes = members.groupBy("cls").agg(F.collect_set("node").alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [
                np.unique(_children(np.array(n, np.int64).view(np.uint64), v, join.children))
                for n, v in zip(batch.column(1).to_pylist(), _matrix(batch.column(2)))
            ]
            sizes = [len(p) for p in paths]
            own = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.concatenate(paths))), batch.column(0).take(own)], names=["node", "cls"]
            )

    rows = looked_up(nodes, classes.select("cls", "lanes"), ["cls"])
    return rows.select("cls", "nodes", "lanes").mapInArrow(run, "node long, cls long")


def met(members: DataFrame) -> DataFrame:
    """Members of nodes of two sets or more."""
    nodes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("pivot"))
    return looked_up(members, nodes.where("n > 1"), ["node"])


def _grouped(docs: DataFrame, text: str, join: Join) -> tuple[DataFrame, DataFrame]:
    """``doc_id, mark, n_shingles, digest, root`` per row, rows with one ``root`` being a group; and per root the
    smallest id, ``least_id``."""
    spark = docs.sparkSession
    signed, full = written(signatures(docs, text, join), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    facts = ("lanes", "nodes", "bits_1", "bits_2")
    per_set = signed.where("digest IS NOT NULL").groupBy("digest").agg(first, *[F.first(c).alias(c) for c in facts])
    per_set = per_set.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), *facts)
    classes, whole = written(per_set.withColumn("cls", F.monotonically_increasing_id()), "classes")
    rows, _ = written(signed.select("doc_id", "mark", "n_shingles", "digest"), "rows")
    discard(spark, full)
    members, path = written(met(classes.select("cls", F.explode("nodes").alias("node"))), "members")
    wanted = looked_up(classes.select("cls", "digest", "first_id", "first_mark"), members.select("cls").distinct(), ["cls"])
    texts, read = written(_texts(docs, wanted, text, join), "texts")
    labels = spark.createDataFrame([], "cls long, root long")
    for step in range(3, join.depth + 1):
        stars = members.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
        near = _estimated(stars, classes, join)
        found, links = written(_confirmed(near, texts, join), "links")
        # What is connected by now needs no comparison.
        labels = components(found.union(labels)).toDF("cls", "root")
        discard(spark, links)
        open_nodes, to = written(unsettled(members, labels), "unsettled")
        discard(spark, path)
        large = (F.col("m") > join.small) & (F.col("r") > join.small) & F.lit(step < join.depth)
        alike, rest = written(_alike(open_nodes.where(~large), classes, join), "alike")
        found, links = written(_confirmed(_compared(alike, texts, join), texts, join), "links")
        discard(spark, rest)
        if not found.isEmpty():
            labels = components(found.union(labels)).toDF("cls", "root")
        discard(spark, links)
        branches = open_nodes.where(large)
        if branches.isEmpty():
            break
        members, path = written(met(_branched(branches, classes, join)), "members")
        discard(spark, to)
    named = looked_up(classes.select("cls", "digest", "first_id"), labels, ["cls"], "left")
    named, _ = written(named.select("digest", "first_id", F.coalesce("root", "cls").alias("root")), "groups")
    discard(spark, whole, read)
    firsts = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    return looked_up(rows, named.select("digest", "root"), ["digest"], "left"), firsts


def near_duplicates(docs: DataFrame, text: str = "text", join: Join | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut at blanks and control blanks into words; the set of a document is its
    distinct shingles of ``join.words`` words. Documents link where 100 * common >= percent * union, confirmed
    on the full sets. ``component_id`` is the smallest doc_id reachable by links, the own included, and ``kept``
    marks the rows whose id it is.

    Rows with equal sets are one node, so copies meet in no task. An empty or null text, or one without words,
    has no shingles and no links: its component is its own id. Rows with a null id take part; their component
    is the smallest id they reach, or null. Rows that repeat an id are rows of their own, linked by their own
    texts. Other columns, of any name, are not read. An empty table gives an empty result.
    """
    with splitting(docs.sparkSession):
        rows, firsts = _grouped(docs, text, join or Join())
        own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
        return looked_up(rows, firsts, ["root"], "left").select(
            "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
        )


def deduplicated(docs: DataFrame, text: str = "text", join: Join | None = None) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``: that of the smallest id, null last.
    Rows without shingles all stay."""
    with splitting(docs.sparkSession):
        rows, _ = _grouped(docs, text, join or Join())
        rows, _ = written(rows.select("doc_id", "mark", "root"), "groups")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
        kept = rows.where("root IS NOT NULL").groupBy("root").agg(first).select(
            F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), F.lit(True).alias("once")
        )
        kept = kept.union(rows.where("root IS NULL").select("doc_id", "mark", F.lit(False).alias("once")).distinct())
        kept = kept.select(id_text("doc_id").alias("_id"), F.col("mark").alias("_mark"), "once")
        names = docs.columns
        marked = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), id_text("doc_id").alias("_id"), F.xxhash64(text).alias("_mark")
        )
        found = looked_up(marked, kept, ["_id", "_mark"])
        # Only a row that is there twice with the same id and text can come up twice.
        twice = rows.where("root IS NOT NULL").groupBy("doc_id", "mark").count().where("count > 1")
        if not twice.isEmpty():
            again = found.where("once").dropDuplicates(["_id", "_mark"])
            found = again.unionByName(found.where("NOT once"))
        return found.select("row.*")


def id_text(name: str) -> Column:
    """The id as text, with null as a value that a join finds."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias(name)
