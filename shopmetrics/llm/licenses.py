"""Licenses named or quoted in documents, by conditional compression (operator 2).

Text that quotes a template compresses far better when the template is the compressor's raw dictionary. The sentences of
a document that hold a word of the subject are the candidate blocks. Each block is compressed with every template, the
templates are ranked by the bytes they save, and the first one that the exact wording confirms wins: the quoted span
differs in few words, holds words that name the license, and none that name another one. What stands before and after
the span is judged again.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: The names that notices give the license.
    names: tuple[str, ...]
    #: Sentences of its usual notices.
    sentences: tuple[str, ...]
    #: Words that tell it from others; a notice holds all words of one of these.
    marks: tuple[str, ...]


def _gnu(name: str, short: str, version: str, marks: str) -> Template:
    return Template(
        (f"GNU {name}, version {version}", f"GNU {name} v{version}", f"GNU {name} {version}", f"{short}v{version}", f"{short}-{version}"),
        (
            f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
            f"Foundation, either version {version} of the License, or (at your option) any later version",
        ),
        (f"{marks} {version}", f"{short.lower()}v {version}", f"{short.lower()} {version}"),
    )


def _commons(kind: str, short: str) -> Template:
    words = " ".join(re.findall("[a-z]+", kind.lower()))
    return Template(
        (f"Creative Commons {kind} 4.0 International License", f"Creative Commons {kind} 4.0", f"CC {short} 4.0", f"CC-{short}-4.0"),
        (), (f"creative commons {words} 4", f"cc {short.lower().replace('-', ' ')} 4"),
    )


#: Names and common notices of public licenses, in their usual wording.
TEMPLATES: dict[str, Template] = {
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3", "affero general public"),
    "Apache-2.0": Template(
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License"),
        (
            "you may not use this file except in compliance with the License",
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
            "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ),
        ("apache license", "apache licenses", "apache 2", "file except compliance license", "as is basis warranties conditions kind"),
    ),
    "BSD": Template(
        ("BSD License", "BSD-style License"),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ),
        ("bsd license", "bsd licensed", "redistribution source binary forms permitted", "redistributions source retain conditions"),
    ),
    "BSD-2-Clause": Template(
        ("2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause License", "BSD-2-Clause"), (), ("bsd 2 clause", "simplified bsd")
    ),
    "BSD-3-Clause": Template(
        ("3-Clause BSD License", "New BSD License", "Revised BSD License", "BSD 3-Clause License", "BSD-3-Clause"),
        (
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission",
        ),
        ("bsd 3 clause", "new bsd", "revised bsd", "neither name contributors endorse promote"),
    ),
    "CC-BY-4.0": _commons("Attribution", "BY"),
    "CC-BY-NC-4.0": _commons("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-NC-SA-4.0": _commons("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-ND-4.0": _commons("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-SA-4.0": _commons("Attribution-ShareAlike", "BY-SA"),
    "CC0-1.0": Template(
        ("Creative Commons Zero 1.0 Universal", "Creative Commons CC0 1.0 License", "CC0 1.0", "CC0-1.0"), (),
        ("creative commons zero", "creative commons cc 0", "cc 0 1"),
    ),
    "GPL-2.0": _gnu("General Public License", "GPL", "2", "general public"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3", "general public"),
    "ISC": Template(
        ("ISC License", "ISC"),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ),
        ("isc license", "isc licensed", "permission use purpose fee hereby granted"),
    ),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1", "lesser general public"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3", "lesser general public"),
    "MIT": Template(
        ("MIT License", "MIT"),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
        ),
        ("mit license", "mit licensed", "permission hereby granted person software", "hereby granted free charge software"),
    ),
    "MPL-2.0": Template(
        ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"),
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ),
        ("mozilla public license 2", "mozilla public 2", "mpl 2"),
    ),
    "Unlicense": Template(
        ("Unlicense", "The Unlicense"), ("This is free and unencumbered software released into the public domain",),
        ("unlicense license", "the unlicense", "under unlicense", "unencumbered software public domain"),
    ),
    "reserved": Template(
        (), ("All rights reserved", "No part of this work may be reproduced without written permission"),
        ("all rights reserved", "no reproduced without permission"),
    ),
}
#: How notices bring in a name; {} is the name.
LEADS = (
    "{}", "Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the {}", "Available under the {}",
    "This work is licensed under the {}", "This work is licensed under a {}", "This code is {} licensed", "under the terms of the {}",
    "SPDX-License-Identifier: {}",
)
#: Words that make another license of a name; a span that its template lacks one of is of another license.
TELLING = frozenset(
    "apache bsd mit isc mozilla mpl gnu gpl gplv lgpl lgplv agpl agplv lesser library affero noncommercial nc sharealike sa "
    "noderivatives nd zero unlicense clause simplified revised".split()
)
#: Those that stand right before or after a name that is a part of a longer one.
QUALIFIERS = frozenset("lesser library affero noncommercial nc sharealike sa noderivatives nd clause simplified revised".split())
#: A block without any of these is no candidate.
SUBJECT = re.compile(
    rb"licen[cs]|copyright|all rights reserved|redistribut|reproduced|permission|neither the name|creative commons|public domain"
    rb"|\bcc[ -]?(by|0)\b|\ba?l?gpl|\b(mit|gnu|apache|bsd|mozilla|mpl)\b", re.I,
)
#: Where a sentence ends; "v. 2.0" goes on.
ENDS = re.compile(rb"(?<! v)\. ")
WORDS = re.compile(r"[\w.+-]*\w")
_TERMS = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")


def word(text: str) -> str:
    """A word as it is compared: in lower case, v3.0 as v3."""
    return re.sub(r"(?<=\d)(\.0+)+$", "", text.lower())


def terms(text: str) -> frozenset[str]:
    """Words and numbers of a text; 2.0 is 2, and years are left out. The British spelling counts as the American."""
    out = set()
    for term in _TERMS.findall(text.lower()):
        if term[0].isdigit():
            term = re.sub(r"(\.0+)+$", "", term)
            if len(term.split(".")[0]) > 3:
                continue
        out.add({"licence": "license", "licenced": "licensed", "licences": "licenses"}.get(term, term))
    return frozenset(out)


@dataclass(frozen=True)
class Scan:
    templates: Mapping[str, Template] = field(default_factory=lambda: TEMPLATES)
    #: Share of the compressed size of the quoted span that the winner must save.
    least_saved: float = 0.25
    #: Words of a span that its winner doesn't have, at most, as a share of the span's words.
    most_foreign: float = 0.2
    #: Words before and after a word of the subject that a block takes of a long sentence.
    block: int = 96
    level: int = 6


class _Scanner:
    def __init__(self, scan: Scan):
        self.scan = scan
        self.plain = zstandard.ZstdCompressor(level=scan.level, write_content_size=False)
        self.names = sorted(scan.templates)
        self.phrases = {
            n: [*t.sentences, *(lead.format(name) for name in t.names for lead in LEADS)] for n, t in scan.templates.items()
        }
        self.words = {n: [[word(w) for w in WORDS.findall(p)] for p in self.phrases[n]] for n in self.names}
        self.terms = {n: terms(" ".join(self.phrases[n])) for n in self.names}
        self.marks = {n: [terms(m) for m in scan.templates[n].marks] for n in self.names}
        self.primed = {}
        for n in self.names:
            text = ". ".join(self.phrases[n]).lower().encode()
            raw = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=scan.level)
            self.primed[n] = zstandard.ZstdCompressor(level=scan.level, write_content_size=False, dict_data=raw)

    def sizes(self, text: str) -> tuple[int, dict[str, int]]:
        """Compressed bytes of a text alone, and with each template."""
        data = text.lower().encode("utf-8", "replace")
        return len(self.plain.compress(data)), {n: len(self.primed[n].compress(data)) for n in self.names}

    def ranked(self, text: str) -> list[str]:
        """The templates that save bytes of a text, the one that saves most first, ties by name."""
        plain, sizes = self.sizes(text)
        return sorted((n for n in self.names if sizes[n] < plain), key=lambda n: (sizes[n], n))

    def spans(self, own: Sequence[str], name: str) -> Iterator[tuple[int, int, list[int]]]:
        """Spans of the words that quote a phrase of the template, and the places of the words in them that it lacks:
        from each shared run on, the next runs are taken in while the words that differ on either side are few."""
        for words in self.words[name]:
            runs = [r for r in difflib.SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks() if r.size]
            for held in range(len(runs)):
                first, last, foreign, skipped, quoted = held, held, 0, 0, runs[held].size
                grown = True
                while grown:
                    grown = False
                    for step in (-1, 1):
                        near = (first if step < 0 else last) + step
                        if not 0 <= near < len(runs):
                            continue
                        one, two = (runs[near], runs[first]) if step < 0 else (runs[last], runs[near])
                        more, less = two.a - one.a - one.size, two.b - one.b - one.size
                        size = quoted + foreign + more + runs[near].size
                        if max(foreign + more, skipped + less) <= self.scan.most_foreign * size:
                            foreign, skipped, quoted, grown = foreign + more, skipped + less, quoted + runs[near].size, True
                            first, last = min(first, near), max(last, near)
                start, stop = runs[first].a, runs[last].a + runs[last].size
                same = {k for r in runs[first : last + 1] for k in range(r.a, r.a + r.size)}
                yield start, stop, [k for k in range(start, stop) if k not in same]

    def confirmed(self, own: Sequence[str], start: int, stop: int, name: str) -> bool:
        """Whether the wording of a span is that of this license and of no other."""
        span = terms(" ".join(own[start:stop]))
        numbers = {t for t in span if t[0].isdigit()}
        if not any(m <= span for m in self.marks[name]) or not (span & TELLING) | numbers <= self.terms[name]:
            return False
        after = own[stop : stop + 2] if own[stop : stop + 1] in (["version"], ["v"]) else own[stop : stop + 1]
        around = terms(" ".join([*own[max(0, start - 1) : start], *after]))
        versions = {t for w in after for t in terms(w) if t[0].isdigit()} if re.fullmatch(r"v?[\d.]+", "".join(after[-1:])) else set()
        return not ((around & QUALIFIERS) | versions) - self.terms[name]

    def judge(self, block: str) -> list[tuple[str, int, int, list[str], str]]:
        """The licenses of a block in order: name, bytes that the template saves of the quoted span, its plain size, the
        words that the template doesn't have, and the span."""
        places = [(m.start(), m.end()) for m in WORDS.finditer(block)]
        own = [word(block[i:j]) for i, j in places]
        found, parts = [], [(0, len(own))]
        while parts:
            low, high = parts.pop()
            if low == high:
                continue
            text = block[places[low][0] : places[high - 1][1]]
            held, best = terms(text), None
            for name in self.ranked(text):
                if not any(m <= held for m in self.marks[name]):
                    continue  # no span of it could be confirmed
                for start, stop, foreign in self.spans(own[low:high], name):
                    if best and stop - start - 2 * len(foreign) <= best[0] or not self.confirmed(own[low:high], start, stop, name):
                        continue
                    quoted = block[places[low + start][0] : places[low + stop - 1][1]]
                    plain, sizes = self.sizes(quoted)
                    if plain - sizes[name] >= self.scan.least_saved * plain:
                        notice = (name, plain - sizes[name], plain, [own[low + k] for k in foreign], quoted)
                        best = stop - start - 2 * len(foreign), low + start, low + stop, notice
                if best:
                    break
            if best:
                _, start, stop, notice = best
                found.append((start, notice))
                parts += [(low, start), (stop, high)]
        return [notice for _, notice in sorted(found, key=lambda f: f[0])]

    def blocks(self, text: str) -> Iterator[tuple[int, str]]:
        """Line numbers and the sentences that hold a word of the subject; of long ones the words around these."""
        for number, line in enumerate(text.split("\n")):
            data, start, last = line.encode("utf-8", "replace"), 0, 0
            ends = ENDS.finditer(data)
            for hit in SUBJECT.finditer(data):
                if hit.start() < last:
                    continue
                start = max(start, last)
                for end in ends:
                    if end.start() >= hit.end():
                        last = end.start() + 1
                        break
                    start = max(start, end.end())
                else:
                    last = len(data)
                yield from ((number, b) for b in self._around(data[start:last].decode("utf-8", "replace").strip()))

    def _around(self, sentence: str) -> Iterator[str]:
        places = [(m.start(), m.end()) for m in WORDS.finditer(sentence)]
        if len(places) <= 2 * self.scan.block:
            yield sentence
            return
        # Words near one of the subject's, in stretches that don't overlap.
        low = high = 0
        for k in range(len(places)):
            i, j = places[k][0], places[min(k + 3, len(places) - 1)][1]
            if not SUBJECT.match(sentence[i:j].encode("utf-8", "replace")):
                continue
            if k - self.scan.block > high:
                if high > low:
                    yield sentence[places[low][0] : places[high - 1][1]]
                low = k - self.scan.block
            elif high - low > 4 * self.scan.block and k >= high:
                yield sentence[places[low][0] : places[high - 1][1]]
                low = high
            high = max(high, min(len(places), k + self.scan.block))
        if high > low:
            yield sentence[places[low][0] : places[high - 1][1]]

    def scan_text(self, text: str | None) -> list[dict]:
        return [
            {"license": name, "line": number, "saved_bytes": gain, "plain_bytes": plain, "differences": foreign, "quoted": quoted}
            for number, block in self.blocks(text or "")
            for name, gain, plain, foreign, quoted in self.judge(block)
        ]


@functools.lru_cache(maxsize=4)
def _scanner(key: tuple, scan_items: tuple) -> _Scanner:
    return _Scanner(Scan(dict(scan_items), *key))


FOUND = "array<struct<license:string,line:int,saved_bytes:int,plain_bytes:int,differences:array<string>,quoted:string>>"


def licenses(docs: DataFrame, text: str = "text", scan: Scan | None = None) -> DataFrame:
    """``doc_id, licenses`` for each row of ``docs``: the notices found in the whole text in order, with ``license``,
    ``line`` (from 0), the bytes that the template saves of the quoted part and its plain compressed size, the words of
    the quoted part that differ from the template (``differences``), and the quoted part. A sentence may hold several;
    words around a notice don't count against it. A notice of a license or version without a template has no name.

    One narrow pass over the documents. Null and empty texts have none; equal gains go to the first name; repeated
    rows are each answered. Other columns, of any name, are not read. An empty table gives an empty result.
    """
    scan = scan or Scan()
    key = (scan.least_saved, scan.most_foreign, scan.block, scan.level)
    items = tuple(sorted(scan.templates.items()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    inner = pa.list_(
        pa.struct(
            [
                ("license", pa.string()), ("line", pa.int32()), ("saved_bytes", pa.int32()), ("plain_bytes", pa.int32()),
                ("differences", pa.list_(pa.string())), ("quoted", pa.string()),
            ]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, items)
        for batch in batches:
            found = [scanner.scan_text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, inner)], names=["doc_id", "licenses"])

    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, licenses {FOUND}")


def license_names(docs: DataFrame, text: str = "text", scan: Scan | None = None) -> DataFrame:
    """``doc_id, n_notices, licenses, saved_bytes, differing_words`` per row: the names found, in order of the alphabet."""
    found = licenses(docs, text, scan)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_notices"), F.array_sort(F.array_distinct("licenses.license")).alias("licenses"),
        total(F.col("licenses.saved_bytes")).alias("saved_bytes"),
        total(F.transform("licenses.differences", lambda d: F.size(d))).alias("differing_words"),
    )
