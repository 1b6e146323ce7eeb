"""Byte-level BPE encoding and decoding (operator 13).

A text is cut into words by the vocabulary's pattern. A word starts as a doubly linked list of bytes; a priority queue
holds the neighbours that may merge, least rank first and then leftmost. Entries that an earlier merge made stale are
skipped when they come up. Decoding concatenates the strings of the vocabulary.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a task remembers, and the longest of them.
KNOWN_WORDS, KNOWN_LENGTH = 120_000, 48
#: Words of one text, and rows of a batch, that are held at once.
AT_ONCE, ROWS = 1 << 17, 500
#: Texts of characters below this one are cut by the faster pattern.
EUROPEAN = 0x250

# The pattern of byte-level vocabularies, and the bytes that stand for themselves in their strings.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary's strings stands for."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


def _european() -> str:
    """The pattern for texts of characters below ``EUROPEAN``, its classes spelled out: the plain ``re`` reads it faster."""
    kinds = ((name, regex.compile(name)) for name in (r"\p{L}", r"\p{N}", r"\s"))
    spelled = {name: "".join(re.escape(chr(c)) for c in range(EUROPEAN) if kind.match(chr(c))) for name, kind in kinds}
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(spelled.values())}]").replace(r"\S", f"[^{spelled[r'\s']}]")
    for name, characters in spelled.items():
        pattern = pattern.replace(name, f"[{characters}]")
    return pattern


class _Words(dict):
    """The ids of each word, worked out once. Full, it starts anew and takes over what comes up again."""

    def __init__(self, merged):
        super().__init__()
        self.merged, self.before = merged, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.merged(word.encode())
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A byte-level vocabulary of the tokenizers library, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, added = stored["model"], stored.get("added_tokens") or []
        self._known_kind(stored, model, added)
        byte_of, vocabulary = alphabet(), model["vocab"]
        strings = {k: self._bytes(token, byte_of) for token, k in vocabulary.items()}
        strings |= {t["id"]: self._bytes(t["content"], byte_of) for t in added}
        #: Per id the bytes it stands for; empty where no token has the id.
        self.strings = [strings.get(k, b"") for k in range(max(strings) + 1)]
        self.first = [0] * 256
        for character, byte in byte_of.items():
            self.first[byte] = vocabulary[character]
        #: Per left id the ranks of the right ids it merges with, and the id that each rank makes.
        none: dict[int, int] = {}
        self.ranks, self.made = [none] * len(self.strings), []
        for rank, merge in enumerate(model["merges"]):
            left, right = (vocabulary[m] for m in (merge if isinstance(merge, list) else merge.split(" ")))
            if self.ranks[left] is none:
                self.ranks[left] = {}
            self.ranks[left][right] = rank
            self.made.append(vocabulary["".join(merge) if isinstance(merge, list) else merge.replace(" ", "", 1)])
        self.packed = [struct.pack("<I", k) for k in range(len(self.strings))]
        self.patterns = regex.compile(PATTERN), re.compile(_european()), re.compile(f"[{chr(EUROPEAN)}-{chr(0x10FFFF)}]")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        longest_first = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(longest_first)})") if added else None
        self.words = _Words(self.merged)

    @staticmethod
    def _known_kind(stored: dict, model: dict, added: list[dict]) -> None:
        cut = stored.get("pre_tokenizer") or {}
        other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        other += [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        other += [k for k in ("lstrip", "rstrip", "single_word") if any(t.get(k) for t in added)]
        if model.get("type") != "BPE" or stored.get("normalizer") or other:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {other or model.get('type')}")
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"words are cut in another way: {cut}")

    @staticmethod
    def _bytes(token: str, byte_of: dict[str, int]) -> bytes:
        return bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()

    def merged(self, word: bytes) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        n, ranks, made, push, pop = len(word), self.ranks, self.made, heapq.heappush, heapq.heappop
        ids = [self.first[b] for b in word]
        # Ranks and places share one number; ranks count first.
        shift = n.bit_length()
        queue = [r << shift | k for k, (a, b) in enumerate(pairwise(ids)) if (r := ranks[a].get(b)) is not None]
        if not queue:
            return b"".join([self.packed[k] for k in ids])
        heapq.heapify(queue)
        after, before, mask = list(range(1, n + 1)), list(range(-1, n)), (1 << shift) - 1
        ids.append(-1)  # behind the last symbol: merges with nothing
        while queue:
            entry = pop(queue)
            rank, place = entry >> shift, entry & mask
            own, right = ids[place], after[place]
            if own < 0 or ranks[own].get(ids[right]) != rank:
                continue  # an earlier merge took one of the two
            own = ids[place] = made[rank]
            ids[right] = -1
            right = after[place] = after[right]
            before[right] = place
            if (rank := ranks[own].get(ids[right])) is not None:
                push(queue, rank << shift | place)
            left = before[place]
            if left >= 0 and (rank := ranks[ids[left]].get(own)) is not None:
                push(queue, rank << shift | left)
        return b"".join([self.packed[k] for k in ids if k >= 0])

    def _plain(self, text: str) -> bytes:
        ids, (pattern, european, other) = self.words.__getitem__, self.patterns
        if not other.search(text):
            pattern = european
        if len(text) < AT_ONCE:
            return b"".join(map(ids, pattern.findall(text)))
        found, parts = pattern.finditer(text), []
        while some := [m.group() for m in islice(found, AT_ONCE)]:
            parts.append(b"".join(map(ids, some)))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers. An added token's string in the text is that
        token; the texts around it are encoded on their own."""
        if not self.special or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added.get(p) or self._plain(p) for p in self.special.split(text))

    def decode(self, ids: bytes) -> str:
        """The text of some ids. Ids that no token has stand for nothing; bytes that are no UTF-8 become U+FFFD."""
        strings, numbers = self.strings, np.frombuffer(ids, "<u4").tolist()
        if numbers and max(numbers) >= len(strings):
            numbers = [k for k in numbers if k < len(strings)]
        return b"".join(map(strings.__getitem__, numbers)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """A vocabulary, read once by each Python worker."""
    return Bpe(path)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``ROWS``, so that little besides the texts is held."""
    for batch in batches:
        yield from (batch.slice(start, ROWS) for start in range(0, batch.num_rows, ROWS))


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row of ``docs``: the ids of its whole text under the vocabulary at ``path``, a
    file that all machines see, as little-endian unsigned 32-bit integers.

    Nothing is cut, padded or added. A null or empty text has no tokens. Rows are encoded one by one: rows that repeat
    an id, or have none, are rows of their own. Other columns, of any name, are not read. An empty table gives an empty
    result. A text of n characters that is a single word takes n log n steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        for batch in _sliced(batches):
            ids = [encode(v.as_buffer().to_pybytes().decode("utf-8", "replace")) if v.is_valid else b"" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of ``rows`` as they are, with the text of the ids as ``decoded``; null ids are an empty
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path).decode
        for batch in _sliced(batches):
            texts = [decode(v.as_buffer().to_pybytes()) if v.is_valid else "" for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    plain = rows.select("doc_id", "n_tokens", "ids")
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
