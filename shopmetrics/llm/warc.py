"""WARC archives of pages, written by ranges of page ids and read back (operator 8).

Pages are cut into shards by ranges of their ids that hold about equally many bytes; the cuts follow from the ids
alone, so every run writes the same files. A shard is sorted, and written record by record into files that are closed
when their compressed size is reached. Headers and digests are made anew; a payload that a page with a larger id holds
too is written as a revisit of that page. Files get their names when they are complete, and the manifest lists them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import looked_up, new_folder, splitting, staged, tasks
from shopmetrics.llm.files import Committed, located

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
END = b"\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    #: Payloads of fewer bytes are always written whole.
    least_shared: int = 1_000
    #: Compressed bytes after which a file is closed.
    roll: int = 64 << 20
    #: Payload bytes of a shard, about: a 64th of the input's between these bounds, whatever the cluster. A large shard
    #: holds several files of ``roll`` bytes.
    shard: int = 32 << 20
    largest_shard: int = 1 << 30
    #: Shards that one task writes, at most.
    together: int = 8
    #: The date that all records carry: it must not change from run to run.
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6


def _histogram(facts: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Bytes of the ids from each edge up to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), "right") - 1
            sums = np.bincount(at, batch.column(1).to_numpy(), len(edges))
            held = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held].astype(np.int64))], names=["at", "bytes"])

    sums = facts.where("page_id IS NOT NULL").select("page_id", F.col("bytes") + 512).mapInArrow(run, "at long, bytes long")
    out = np.zeros(len(edges), np.int64)
    for row in sums.groupBy("at").agg(F.sum("bytes").alias("bytes")).collect():  # at most one row per edge
        out[row["at"]] = row["bytes"]
    return out


def _cuts(facts: DataFrame, archive: Archive) -> tuple[np.ndarray, np.ndarray, int]:
    """First ids of the shards' ranges, into how many shards each range is cut (one, but for a single id that fills
    several), and how many shards rows without an id fill. At most about 300,000 edges at 100 TB."""
    size, null = F.col("bytes") + 512, F.col("page_id").isNull()
    row = facts.agg(F.min("page_id"), F.max("page_id"), F.sum(size), F.sum(F.when(null, size))).first()
    archive = replace(archive, shard=max(archive.shard, min(archive.largest_shard, (row[2] or 0) // 64)))
    nameless = max(1, -(-(row[3] or 0) // archive.shard))
    if row[0] is None:
        return np.array([0]), np.array([1]), nameless
    low, high = int(row[0]), int(row[1])
    step = max(1, -(-(high - low + 1) // 256))
    edges = np.array(sorted({low + k * step for k in range(256) if low + k * step <= high}), np.int64)
    while True:
        sums = _histogram(facts, edges)
        ends = np.append(edges[1:], high + 1)
        heavy = (sums > archive.shard // 2) & (ends - edges > 1)
        if not heavy.any():
            break
        finer = [
            np.arange(int(a), int(b), max(1, -(-(int(b) - int(a)) // 64)), dtype=np.int64) for a, b in zip(edges[heavy], ends[heavy])
        ]
        edges = np.unique(np.concatenate([edges, *finer]))
    firsts, parts, fill = [], [], 0
    for edge, size in zip(edges, sums):
        if not firsts or (fill and fill + size > archive.shard):
            firsts.append(edge)
            parts.append(1)
            fill = 0
        fill += int(size)
        if size > archive.shard:
            parts[-1] = int(-(-size // archive.shard))
    return np.array(firsts), np.array(parts), nameless


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str, copy: str = "") -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{payload_digest}{f':{copy}' if copy else ''}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "replace") for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + END


def page_record(page_id: int | None, url: str | None, payload: bytes, holder: int | None, copy: str, date: str) -> bytes:
    """The record of a page: the response, or, with ``holder``, the revisit of the page that has the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").strip() or f"urn:page:{page_id}"
    block = HTTP.format(len(payload)).encode() + (payload if holder is None else b"")
    headers = [
        ("WARC-Type", "response" if holder is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest, copy)),
        ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
    ]
    if holder is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(holder, digest))]
    return _record([*headers, ("Content-Type", "application/http; msgtype=response")], block)


class _Files:
    """The files of a shard, closed one after the other at their compressed size."""

    def __init__(self, folder: str, shard: int, archive: Archive):
        self.folder, self.shard, self.archive = folder, shard, archive
        self.number, self.out, self.records, self.rows = 0, None, 0, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.out, self.records = Committed(self.folder, self.name), 0
            info = _record(
                [
                    ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.archive.date),
                    ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
                ],
                b"format: WARC File Format 1.1\r\n",
            )
            self._write(info)
        self._write(record)
        self.records += 1
        if self.out.size >= self.archive.roll:
            self.close()

    def _write(self, record: bytes) -> None:
        press = zlib.compressobj(self.archive.level, zlib.DEFLATED, 31)
        self.out.write(press.compress(record) + press.flush())

    def close(self) -> None:
        if self.out is not None:
            self.rows.append((self.name, self.shard, self.records, self.out.commit()))
            self.out, self.number = None, self.number + 1


def write_archives(
    pages: DataFrame, archive: Archive | None = None, folder: str | None = None, html: str = "html", url: str = "url"
) -> tuple[DataFrame, str]:
    """Write one record per row of ``pages`` to ``folder`` (by default a new one in the shared folder). Gives the
    manifest, ``file, shard, records, bytes``, and the folder.

    Of the rows with equal payloads of at least ``archive.least_shared`` bytes, that with the largest ``page_id`` is
    a response and the others are its revisits; smaller payloads are all responses. A null html is an empty payload,
    a null or empty url is named by the page id. Rows with a null id are in shards of their own; they revisit the page
    that holds their payload, and are responses where no page with an id does. Of rows that repeat an id and a payload,
    one is the response and the others revisit that page. Other columns, of any name, are not read. An empty table gives
    no files.
    """
    archive, spark = archive or Archive(), pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # Copies of one payload without ids are dealt to several shards by their urls.
    salt = F.when(F.col("page_id").isNull(), F.pmod(F.hash("url"), F.lit(64))).otherwise(0)
    with splitting(spark):
        facts = staged(
            thin.select(
                "page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"),
                salt.alias("salt"),
            ),
            "payloads",
        )
        firsts, parts, nameless = _cuts(facts, archive)
        starts = np.concatenate([[0], np.cumsum(parts)])
        shards = int(starts[-1])
        shared = facts.where(F.col("bytes") >= archive.least_shared)
        holders = shared.groupBy("digest", "bytes").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        holders = holders.where("n > 1 AND holder IS NOT NULL")
        revisits = looked_up(shared, holders, ["digest", "bytes"]).where("page_id IS NULL OR page_id < holder")
        revisits = revisits.select("page_id", "digest", "holder", "salt").distinct()
        null = lambda kind: F.lit(None).cast(kind)
        rows = thin.select("page_id", F.lit(1).alias("kind"), "url", "html", null("string").alias("digest"), null("long").alias("holder"), salt.alias("salt"))
        rows = rows.union(revisits.select("page_id", F.lit(0), null("string"), null("string"), "digest", "holder", "salt"))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = []
                for page_id, html, digest, salt in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 6))):
                    key = lambda: int((digest or hashlib.sha1(html.encode()).hexdigest())[:8], 16)  # noqa: B023, E731
                    if page_id is None:  # beyond the ranges
                        own.append(shards + (key() + salt) % nameless)  # noqa: B023
                        continue
                    at = int(np.searchsorted(firsts, page_id, "right")) - 1
                    own.append(int(starts[at]) + (key() % int(parts[at]) if parts[at] > 1 else 0))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

        placed = rows.mapInArrow(place, "shard long, page_id long, kind int, url string, html string, digest string, holder long, salt int")
        # Ranges of consecutive shards, evenly dealt; few shards are a task each.
        ranges = min(shards + nameless, max(4 * tasks(spark), -(-(shards + nameless) // archive.together)))
        range_of = F.floor(F.col("shard") * ranges / (shards + nameless)).cast("int")
        placed = placed.repartitionById(ranges, range_of).sortWithinPartitions("shard", "page_id", "kind", "url", "html")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, page, holders, copies = None, None, {}, {}
            done: list[tuple] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if files is None or row["shard"] != files.shard:
                        if files is not None:
                            files.close()
                            done += files.rows
                        files, page = _Files(folder, row["shard"], archive), (None,)
                    if page != row["page_id"]:
                        page, holders, copies = row["page_id"], {}, {}
                    if row["kind"] == 0:
                        holders[row["digest"]] = row["holder"]
                        continue
                    payload = row["html"].encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    copy = copies[digest] = copies.get(digest, -1) + 1
                    holder = holders.get(digest)
                    if holder is None and copy and page is not None and len(payload) >= archive.least_shared:
                        holder = page
                    label = f"{row['shard']}-{copy}" if page is None else str(copy or "")
                    files.add(page_record(page, row["url"], payload, holder, label, archive.date))
            if files is not None:
                files.close()
                done += files.rows
            yield pa.RecordBatch.from_pydict(
                {"file": [d[0] for d in done], "shard": [d[1] for d in done], "records": [d[2] for d in done], "bytes": [d[3] for d in done]},
                schema=pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64())]),
            )

        written = placed.mapInArrow(write, "file string, shard long, records long, bytes long")
        written.write.parquet(f"{folder}/manifest")
    return spark.read.schema(written.schema).parquet(f"{folder}/manifest"), folder


def records_of(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, one in memory at a time."""
    filesystem, path = located(folder)
    with filesystem.open_input_stream(f"{path}/{name}", compression=None) as file:
        member, parts, rest = zlib.decompressobj(31), [], b""
        while data := rest or file.read(1 << 20):
            parts.append(member.decompress(data))
            rest = member.unused_data
            if member.eof:
                head, _, body = b"".join(parts).partition(b"\r\n\r\n")
                version, *lines = head.decode().split("\r\n")
                headers = dict(line.split(": ", 1) for line in lines)
                if version.encode() != VERSION or len(body) != int(headers["Content-Length"]) + len(END):
                    raise ValueError(f"{name}: damaged record {headers.get('WARC-Record-ID')}")
                yield headers, body[: -len(END)]
                member, parts = zlib.decompressobj(31), []
        if parts:
            raise ValueError(f"{name}: ends within a record")


def _page_of(record_id: str) -> int | None:
    number = record_id.split(":")[2]
    return int(number) if number else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to`` of each page record in the files
    of the manifest; ``html`` is null for revisits. Blocks and payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in records_of(folder, name):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    own = headers["WARC-Payload-Digest"]
                    if _digest(block) != headers["WARC-Block-Digest"] or kind == "response" and (_digest(payload), len(payload)) != (own, size):
                        raise ValueError(f"{name}: {headers['WARC-Record-ID']} does not match its digest")
                    rows.append(
                        {
                            "page_id": _page_of(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"],
                            "html": payload.decode() if kind == "response" else None, "payload_bytes": size,
                            "payload_digest": base64.b32decode(own.removeprefix("sha1:")).hex(), "record_type": kind,
                            "refers_to": _page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None,
                        }
                    )
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = manifest.select("file").repartition(tasks(manifest.sparkSession))
    return files.mapInArrow(
        run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
