"""License scans: winnowed fingerprints pick templates, banded alignment reports them.

The templates' k-grams of words are hashed and winnowed (the smallest hash of
every ``WINDOW`` neighbours is kept) into an inverted index from hash to template
and place.  A document is winnowed alike, so every common run of
``GRAM + WINDOW - 1`` words shares a fingerprint; hits of one template that lie near
each other make a candidate.  The template is then aligned with the words around
the candidate inside a band of ``BAND`` words about the diagonal of its hits.  Its
coverage is the number of matched words over the template's words plus the words
of the text that stand unmatched between them.  A match is reported, with the byte
range of each matched run, if

* its coverage is at least ``COVERAGE``;
* the template's ``REQUIRED`` words (family, variant, version) are matched; only a
  version number may be left out, with nothing in its place inside the match;
* no other ``VARIANTS`` word stands unmatched between the matched ones, so that a
  licence nobody listed is not taken for its nearest relative.

The templates are a small set and travel with the task; documents are read once
and never shuffled.  ``stored_templates`` reads further ones, such as the full texts
of long licences, from a folder.

Defined results: a NULL, empty or wordless text has no matches; a template of
fewer than ``GRAM`` words is indexed by all its words; several matches of one
template are several rows; of matches that overlap the one with the most words is reported, of
equal ones the last by name (the latest version); repeated rows give repeated matches; other columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Prefix, record_batch, ship, slices, word_hashes, word_spans
from .fingerprints import sliding_min

GRAM, WINDOW = 3, 2
BAND = 6
COVERAGE = 0.8

# The wording of common licence notices and of the short licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met."
    ),
    "BSD conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "BSD endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "BSD disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
        "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "ISC": "Released under the ISC License.",
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "MIT disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions."
    ),
}
# The words that tell a template from its relatives.
REQUIRED = {
    "AGPL-3.0": "affero 3",
    "AGPL-3.0 notice": "affero 3",
    "Apache-2.0": "apache 2",
    "Apache-2.0 header": "apache 2",
    "BSD-2-Clause": "bsd 2 clause",
    "BSD-3-Clause": "bsd 3 clause",
    "BSL-1.0": "boost 1",
    "CC-BY-4.0": "cc by 4",
    "CC-BY-NC-4.0": "cc by nc 4",
    "CC-BY-NC-ND-4.0": "cc by nc nd 4",
    "CC-BY-NC-SA-4.0": "cc by nc sa 4",
    "CC-BY-ND-4.0": "cc by nd 4",
    "CC-BY-SA-4.0": "cc by sa 4",
    "CC0-1.0": "cc0 1",
    "EPL-2.0": "eclipse 2",
    "GPL-2.0": "general 2",
    "GPL-2.0 notice": "general 2",
    "GPL-3.0": "general 3",
    "GPL-3.0 notice": "general 3",
    "ISC": "isc",
    "LGPL-2.1": "lesser 2 1",
    "LGPL-2.1 notice": "lesser 2 1",
    "LGPL-3.0": "lesser 3",
    "LGPL-3.0 notice": "lesser 3",
    "MIT": "mit",
    "MPL-2.0": "mozilla 2",
}
VARIANTS = "affero lesser library nc nd sa noncommercial noderivatives sharealike"
#: Bytes of the templates that ``stored_templates`` takes to the driver.
TEMPLATE_BYTES = 16 << 20


@dataclass(frozen=True)
class Words:
    """Hashes and byte ranges of the words of some texts."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        low = LOWER[data]
        starts, ends, bounds = word_spans(low, offsets, ALNUM)
        return cls(word_hashes(low, starts, ends), starts, ends, bounds)

    @classmethod
    def of_text(cls, text: str) -> Words:
        raw = np.frombuffer(text.encode(), np.uint8)
        return cls.of(raw, np.array([0, len(raw)]))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the k-grams that are the (rightmost) smallest of some window."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.arange(min(1, len(hashes)))
    least = sliding_min(hashes, WINDOW)
    at = np.arange(n)
    for step in range(WINDOW):
        here = np.arange(n) + step
        at = np.where(hashes[here] == least, here, at)
    return np.unique(at)


class Index:
    """Winnowed templates by fingerprint, and the places of their required words."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, required: dict[str, str] = REQUIRED):
        self.names = sorted(templates)
        self.words: list[list[int]] = []
        self.required: list[set[int]] = []
        self.numbers: set[int] = set()
        self.variants = set(Words.of_text(VARIANTS).hashes.tolist())
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, name in enumerate(self.names):
            words = Words.of_text(templates[name])
            self.words.append(words.hashes.tolist())
            wanted = set(Words.of_text(required.get(name, "")).hashes.tolist())
            self.required.append({at for at, word in enumerate(self.words[-1]) if word in wanted})
            numbers = " ".join(filter(str.isdigit, required.get(name, "").split()))
            self.numbers.update(Words.of_text(numbers).hashes.tolist())
            width = min(GRAM, len(words.hashes))
            grams = Prefix(words.hashes).windows(width) if width else words.hashes
            for at in winnow(grams).tolist():
                places[int(grams[at])].append((number, at))
        self.places = dict(places)
        self.widths = sorted({min(GRAM, len(w)) for w in self.words if w})
        self.known = np.sort(np.fromiter(self.places, np.uint64, len(self.places)))

    def share(self, number: int, text: list[int], pairs: list[tuple[int, int]]) -> float:
        """Coverage of a template by an alignment; 0 if another licence's words tell against it."""
        if not pairs:
            return 0.0
        place = dict(pairs)
        for at in self.required[number] - place.keys():
            before, after = place.get(at - 1), place.get(at + 1)
            if self.words[number][at] not in self.numbers or before is None or after != before + 1:
                return 0.0
        matched = {j for _, j in pairs}
        between = [text[j] for j in range(pairs[0][1], pairs[-1][1]) if j not in matched]
        if not self.variants.isdisjoint(between):
            return 0.0
        return len(pairs) / (len(self.words[number]) + len(between))

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """``(text, template, diagonal, word)`` of every fingerprint in common."""
        if not len(self.known):
            return
        prefix = Prefix(words.hashes)
        for width in self.widths:
            grams = prefix.windows(width)
            if not len(grams):
                continue
            at = winnow(grams)
            near = self.known[np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)]
            for word in at[near == grams[at]].tolist():
                text = int(np.searchsorted(words.bounds, word, "right")) - 1
                if word + width > words.bounds[text + 1]:
                    continue
                for number, place in self.places[int(grams[word])]:
                    yield text, number, word - place, word


def align(template: list[int], text: list[int], first: int, band: int = BAND) -> list[tuple[int, int]]:
    """Matched ``(template word, text word)`` pairs of the best alignment in a band.

    ``first`` is the text word that the template's first word faces.  The longest
    common subsequence of cells no further than ``band`` from that diagonal.
    """
    width = 2 * band + 1
    best = [[0] * (width + 2) for _ in range(len(template) + 1)]
    for i in range(1, len(template) + 1):
        row, above = best[i], best[i - 1]
        for d in range(1, width + 1):
            j = first + i - 1 + d - band - 1  # the text word of this cell
            same = 0 <= j < len(text) and text[j] == template[i - 1]
            row[d] = max(above[d] + 1 if same else 0, above[d + 1], row[d - 1])
    pairs = []
    i, d = len(template), max(range(1, width + 1), key=lambda c: (best[-1][c], -abs(c - band - 1)))
    while i > 0 and d > 0:
        j = first + i - 1 + d - band - 1
        here = best[i][d]
        if 0 <= j < len(text) and text[j] == template[i - 1] and here == best[i - 1][d] + 1:
            pairs.append((i - 1, j))
            i -= 1
        elif here == best[i][d - 1]:
            d -= 1
        else:
            i, d = i - 1, d + 1
            if d > width:
                break
    return pairs[::-1]


MATCHES = (
    "doc_id long, license string, coverage double, n_matched int, start long, end long, "
    "spans array<struct<lo:long,hi:long>>"
)
_MATCHES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("license", pa.string()),
        ("coverage", pa.float64()),
        ("n_matched", pa.int32()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
    ]
)


def matches(index: Index, words: Words, coverage: float) -> Iterator[tuple[int, str, float, list[int]]]:
    """Text number, template, coverage and matched words of every reported match."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for text, number, diagonal, word in index.hits(words):
        found[text, number].append((diagonal, word))
    aligned: dict[int, list[tuple]] = defaultdict(list)
    for (text, number), hits in sorted(found.items()):
        template = index.words[number]
        lo, hi = words.bounds[text], words.bounds[text + 1]
        done, tried = -1, set()
        for diagonal, word in sorted(hits, key=lambda hit: hit[1]):
            if word <= done or diagonal in tried:
                continue
            tried.add(diagonal)
            a = max(lo, diagonal - BAND)
            own = words.hashes[a : min(hi, diagonal + len(template) + BAND)].tolist()
            pairs = align(template, own, diagonal - a)
            share = index.share(number, own, pairs)
            if pairs and share >= coverage:
                at = [int(a) + j for _, j in pairs]
                done = at[-1]
                aligned[text].append((-len(at), -share, -number, at))
    for text, rivals in sorted(aligned.items()):  # of matches that overlap the longest is reported
        taken: list[tuple[int, int]] = []
        for _, share, number, at in sorted(rivals):
            if all(at[-1] < first or last < at[0] for first, last in taken):
                taken.append((at[0], at[-1]))
                yield text, index.names[-number], -share, at


def _scan(templates: dict[str, str], required: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, required)
        for part in slices(batches):
            words = Words.of(part.data, part.offsets)
            ids = part.column("doc_id")
            rows = []
            for text, name, share, at in matches(index, words, coverage):
                shift = part.offsets[text]
                cuts = [0, *(np.flatnonzero(np.diff(at) > 1) + 1).tolist(), len(at)]
                spans = [
                    {"lo": int(words.starts[at[a]] - shift), "hi": int(words.ends[at[b - 1]] - shift)}
                    for a, b in zip(cuts, cuts[1:], strict=False)
                ]
                rows.append((ids[text].as_py(), name, share, len(at), spans[0]["lo"], spans[-1]["hi"], spans))
            if rows:
                yield record_batch(_MATCHES, *map(list, zip(*rows, strict=True)))

    return run


def report(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    coverage: float = COVERAGE,
    required: dict[str, str] = REQUIRED,
) -> DataFrame:
    """One row per template found in a document: coverage, byte range, matched spans.

    ``required`` names the words of templates that a match must hold; templates
    without an entry need none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(TEMPLATES if templates is None else templates, required, coverage), MATCHES)


def stored_templates(spark: SparkSession, folder: str, limit: int = TEMPLATE_BYTES) -> dict[str, str]:
    """The texts of a folder by file name without its suffix.

    More than ``limit`` bytes are refused: templates travel to every task.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1)
    files = spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("name"), "value")
    size = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"{size} bytes of templates, more than {limit}")
    return {row.name: row.value for row in files.collect()}
