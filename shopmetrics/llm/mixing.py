"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 7). DataFrame functions only.

The documents of a source are laid end to end in streams of bounded length, in seeded order; a stream is the source's
part of one shard of the mix. The words of the mix are cut into equal blocks, and each goes to the stream with the
highest quotient w / (2 k + 1), where w is the stream's share of its source's target and k the blocks it has: that
gives each stream an integer quota. A stream then yields its quota: whole passes, and for the rest stretches of its
documents in seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopmetrics.llm.common import WORD, looked_up, splitting, staged, tasks


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources by code point, null last, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Times a source may be repeated.
    most: int = 3
    #: Words of a block, at most; smaller where a source's target holds fewer than ``least_blocks`` of it.
    block: int = 256
    least_blocks: int = 500
    #: Words of a stream, about.
    stream: int = 1_000_000
    #: Words of a stretch that is taken together.
    stretch: int = 512
    seed: int = 11


def ranked(df: DataFrame, name: str, order: list[Column], tie: list[str]) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 in the order, worked out by ranges: no task sees all rows.
    ``tie`` names the columns that tell rows apart."""
    spark = df.sparkSession
    laid = df.repartitionByRange(tasks(spark), *order).withColumn("_part", F.spark_partition_id())
    laid = staged(laid, "ranked")  # the cuts are sampled, so they are stored before they are used twice
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per range.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, *tie)) - 1
    return laid.join(offsets, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources`` (``key``, ``source``, ``source_size``) with ``place``, ``weight`` and ``target`` in words."""
    placed = ranked(sources, "place", [F.col("source").asc_nulls_last()], ["key"])
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    placed = staged(
        placed.withColumn("weight", F.element_at(weights, (F.col("place") % len(mix.weights) + 1).cast("int"))), "sources"
    )
    most = F.lit(float(mix.most)) * F.col("source_size")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    # Words per unit of weight. Each round stops more sources at their limit and shares what they leave.
    level, last = 0.0, None
    while total:
        at_limit = most <= F.lit(level) * F.col("weight")
        row = placed.agg(
            F.coalesce(F.sum(F.when(at_limit, most)), F.lit(0.0)).alias("given"), F.sum(F.when(~at_limit, F.col("weight"))).alias("open"),
            F.count(F.when(at_limit, True)).alias("n"),
        ).first()
        if row["n"] == last:
            break
        last, level = row["n"], (total - row["given"]) / row["open"]
    return placed.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def apportioned(parties: DataFrame, seats: int, weight: str, tie: list[str]) -> DataFrame:
    """``parties`` with ``seats``: the integer shares of ``seats`` by highest quotients ``weight / (2 k + 1)``; equal
    quotients go to the party that comes first by ``tie``. Parties of weight 0 get nothing.

    Two divisors, one that surely seats too few and one that surely seats too many, bound each party's share: only
    the quotients between them, about two per party, are ranked.
    """
    row = parties.agg(F.sum(weight).alias("w"), F.count("*").alias("n")).first()
    if not seats or not row["w"]:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    margin = row["n"] / 2 + 2
    share = lambda many: F.floor(F.col(weight) / F.lit(row["w"] / many) + 0.5).cast("long")
    sure = share(seats - margin) if seats > margin else F.lit(0).cast("long")
    bounds = parties.withColumn("_sure", sure).withColumn("_most", share(seats + margin))
    given = bounds.agg(F.sum("_sure")).first()[0]
    open_seats = bounds.where("_most > _sure").select(*tie, weight, F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    quotients = open_seats.withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    won = ranked(quotients, "_rank", [F.col("_q").desc(), *[F.col(c) for c in tie]], ["_k"]).where(F.col("_rank") < seats - given)
    more = won.groupBy(*tie).agg(F.count("*").alias("_won"))
    return (
        bounds.join(more, tie, "left")
        .withColumn("seats", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_sure", "_most", "_won")
    )


def _key(source: str) -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _taken(docs: DataFrame, text: str, mix: Mix) -> DataFrame:
    rows = staged(
        docs.select(
            "doc_id", F.col("source").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(mix.seed), "doc_id", text).alias("mark"),
        ).withColumns({"key": _key("source"), "row": F.monotonically_increasing_id()}),
        "sizes",
    )
    sources = targets(rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), mix)
    sources = staged(
        sources.withColumn("streams", F.greatest(F.lit(1), F.ceil(F.col("source_size") / mix.stream))).drop("source"), "targets"
    )
    laid = looked_up(rows, sources, ["key"]).withColumn("stream", F.pmod(F.xxhash64("mark"), F.col("streams")))
    stream = ["place", "stream"]
    order = Window.partitionBy(*stream).orderBy("mark", "doc_id", "size", "row")
    laid = staged(
        laid.select(
            "row", "doc_id", "mark", "size", "source_size", "target", *stream,
            F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        ),
        "laid",
    )
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("length") / F.col("source_size")).otherwise(0.0)
    streams = staged(
        laid.groupBy(*stream, "source_size", "target").agg(F.sum("size").alias("length")).withColumn("share", share), "streams"
    )
    facts = sources.agg(F.sum("source_size").alias("words"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = max(1, min(mix.block, int((facts["least"] or 0) / mix.least_blocks)))
    seats = round((facts["words"] or 0) / block)
    quotas = apportioned(streams, seats, "share", stream).withColumn(
        "quota", F.least(F.col("seats") * block, F.col("length") * mix.most)
    )
    quotas = staged(
        quotas.where("length > 0").select(
            *stream, "length", F.expr("quota div length").alias("passes"), F.expr("quota % length").alias("rest"),
            F.greatest(F.lit(1), F.round(F.col("length") / mix.stretch)).cast("long").alias("stretches"),
        ),
        "quotas",
    )
    # Stretch j of n reaches from word floor(j * length / n) to the next one's start.
    pieces = quotas.where("rest > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stretches") - 1)))
    pieces = pieces.withColumns({"from": F.expr("j * length div stretches"), "to": F.expr("(j + 1) * length div stretches")})
    seeded = Window.partitionBy(*stream).orderBy(F.xxhash64(F.lit(mix.seed), *stream, "j"), "j")
    before = F.coalesce(F.sum(F.col("to") - F.col("from")).over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = pieces.withColumn("until", F.col("from") + F.least(F.col("to") - F.col("from"), F.col("rest") - before))
    won = won.where("until > `from`").select(*stream, "j", "from", "until")

    spread = looked_up(laid, quotas, stream, "left").withColumn("start", F.col("end") - F.col("size"))
    touched = F.expr("sequence(((start + 1) * stretches - 1) div length, (end * stretches - 1) div length)")
    spread = spread.withColumn("j", F.explode_outer(F.when((F.col("size") > 0) & (F.col("rest") > 0), touched)))
    shared = F.greatest(F.lit(0), F.least("end", "until") - F.greatest("start", "from"))
    kept = ["row", "doc_id", "mark", "size", "source_size", "target", "passes"]
    per_row = spread.join(won, [*stream, "j"], "left").groupBy(*kept).agg(F.sum(F.coalesce(F.when(F.col("until").isNotNull(), shared), F.lit(0))).alias("part"))
    return per_row.withColumn("taken", (F.coalesce("passes", F.lit(0)) * F.col("size") + F.col("part")).cast("long"))


def mixed(docs: DataFrame, text: str = "text", mix: Mix | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    ``size`` is the number of words of the text; a source's target is its weight's share of all words, at most
    ``mix.most`` times the source's own, with the excess shared by weight among the others until none is above.
    ``taken`` counts the words that the mix takes from the document, repeats counted: at most ``mix.most`` times its
    size, and over a source near its target.

    Null and empty texts have size 0 and give nothing. A null source is a source of its own, the last. Rows that
    repeat, also with null ids, are rows of their own. Other columns, of any name, are not read. An empty table gives
    an empty result. The result follows from the rows and the seed alone; only of rows that are equal in all they hold
    it is open which takes which part.
    """
    with splitting(docs.sparkSession):
        return _taken(docs, text, mix or Mix()).select("doc_id", "size", "source_size", "target", "taken")


def resampled(docs: DataFrame, text: str = "text", mix: Mix | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole: a part is rounded up with a chance equal to it,
    drawn from the row's hash, so that a source's words stay near its target."""
    mix = mix or Mix()
    with splitting(docs.sparkSession):
        taken = staged(_taken(docs, text, mix).select("mark", "size", "taken"), "taken")
        # Rows that are equal in id and text share what they take evenly.
        per_mark = taken.where("size > 0").groupBy("mark").agg((F.sum("taken") / F.sum("size")).alias("times"))
        names = docs.columns
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(F.lit(mix.seed), "doc_id", text).alias("mark"))
        found = looked_up(rows, per_mark, ["mark"])
        draw = F.pmod(F.xxhash64(F.lit(mix.seed + 1), "mark"), F.lit(1 << 20)) / float(1 << 20)
        copies = (F.floor("times") + (draw < F.col("times") - F.floor("times")).cast("int")).cast("int")
        found = found.withColumn("copies", copies).where("copies > 0")
        return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
