"""License scans: winnowed fingerprints, an inverted index of templates, banded alignment (operator 5).

Words are lower-cased and freed of signs. Templates and documents are fingerprinted alike: hashes of
``GRAM`` words, of which every ``WINDOW`` neighbours give at least one, so a shared run of
``GRAM + WINDOW - 1`` words always shares a fingerprint. The index from fingerprint to places in templates
is as large as the templates alone; each task holds it. Hits of one template near one diagonal are a
candidate; a local alignment of the template with the document's words, within a band around that
diagonal, gives the matched words, the part of the template they cover, and the span. All in one narrow stage
without a shuffle.

A match is valid if its words make up ``LEAST_COVERAGE`` of the template and of the words that the text has
inserted within the span, and if the version that the template names (``version 3``, ``2.0``) is among them.
Valid matches that overlap compete: twice the matched words less those left out and inserted decides, so a
longer license wins over its parts and a relative (BSD-2 for BSD-3, GPL for LGPL or AGPL) loses.

Cases: NULL counts as empty; texts without a match give an empty list; a notice found several times is
reported each time; a template of fewer than ``GRAM`` words is refused; repeated rows report alike.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from corpuslens.llm.batches import PLAIN, Rolling, Words, column, slices, winnow
from corpuslens.llm.shared import text_of

GRAM, WINDOW = 3, 2
LEAST_COVERAGE = 0.8
#: Half the width of the band, as a part of the template's words.
BAND = 0.2

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str, thing: str = "This program", later: bool = True) -> str:
    """The paragraph by which a file places itself under a license of the GNU family."""
    terms = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        f"{thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"License as published by the Free Software Foundation, {terms}"
    )


#: Notices, headers and license texts to look for.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": _MIT_GRANT + _AS_IS + (
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": _MIT_GRANT,
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": _BSD_GRANT + _BSD_AS_IS,
    "bsd-2-clause-grant": _BSD_GRANT,
    "bsd-3-clause": _BSD_GRANT + _BSD_NAMES + _BSD_AS_IS,
    "bsd-3-clause-grant": _BSD_GRANT + _BSD_NAMES,
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0-header": _gnu("General Public", "3"),
    "gpl-2.0-header": _gnu("General Public", "2"),
    "gpl-2.0-only-header": _gnu("General Public", "2", later=False),
    "lgpl-3.0-header": _gnu("Lesser General Public", "3"),
    "lgpl-2.1-header": _gnu("Lesser General Public", "2.1", "This library"),
    "agpl-3.0-header": _gnu("Affero General Public", "3"),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work under CC0 1.0 Universal."
    ),
}

MATCH = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("matched_words", T.IntegerType()),
        T.StructField("inserted_words", T.IntegerType()),
        T.StructField("start_byte", T.LongType()),
        T.StructField("end_byte", T.LongType()),
    ]
)


def _fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed positions (of words) and their hashes."""
    n = len(words.begin)
    at = np.arange(n)
    valid = at + GRAM <= np.repeat(words.first[1:], words.count)
    hashes = Rolling(words.hashes).hash(at, np.minimum(at + GRAM, n))
    marked = np.flatnonzero(winnow(hashes, valid, WINDOW))
    return marked, hashes[marked]


#: What names a version: a number with a point, or any after the word "version".
VERSION = re.compile(r"(?<=version )\d[\d.]*|(?<![\w./-])\d+\.\d+", re.IGNORECASE)


class Index:
    """From fingerprint to (template, word) of every template."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = Words(pa.array([templates[n] for n in self.names], pa.string()), PLAIN)
        self.words = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(self.names))]
        # the words that hold a version
        self.versions = [
            {
                int(k)
                for m in VERSION.finditer(templates[name])
                for k in np.flatnonzero((words.begin[a:b] - words.offsets[i] < m.end()) & (words.end[a:b] - words.offsets[i] > m.start()))
            }
            for i, (name, a, b) in enumerate(zip(self.names, words.first, words.first[1:]))
        ]
        if any(len(w) < GRAM + WINDOW - 1 for w in self.words):
            raise ValueError(f"a template needs {GRAM + WINDOW - 1} words")
        at, hashes = _fingerprints(words)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.template = words.owner()[at][order]
        self.place = at[order] - words.first[self.template]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the hash, template and word in it, for all that are in the index."""
        lo, hi = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
        many = hi - lo
        which = np.repeat(np.arange(len(hashes)), many)
        at = np.repeat(lo, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return which, self.template[at], self.place[at]


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """Matched pairs (template word, document word) of the best local alignment within ``band`` of the
    diagonal ``document word = template word + shift``. A match earns 2, a difference or a gap costs 1."""
    m, n = len(template), len(words)
    width = 2 * band + 1
    if 0 <= shift and shift + m <= n and (template == words[shift : shift + m]).all():
        return [(i, i + shift) for i in range(m)]
    t, w = template.tolist(), words.tolist()
    scores, steps, best, end = [0] * width, [], 0, None
    for i in range(m):
        row, step = [0] * width, [0] * width
        for b in range(width):
            j = i + shift + b - band
            if not 0 <= j < n:
                continue
            value, how = scores[b] + (2 if t[i] == w[j] else -1), 1
            if b + 1 < width and scores[b + 1] - 1 > value:  # the template word is left out
                value, how = scores[b + 1] - 1, 2
            if b and row[b - 1] - 1 > value:  # the document word is left out
                value, how = row[b - 1] - 1, 3
            if value > 0:
                row[b], step[b] = value, how
                if value > best:
                    best, end = value, (i, b)
        steps.append(step)
        scores = row
    pairs = []
    while end:
        i, b = end
        how, j = steps[i][b], i + shift + b - band
        if not how:
            break
        if how == 1:
            if t[i] == w[j]:
                pairs.append((i, j))
            end = (i - 1, b)
        else:
            end = (i - 1, b + 1) if how == 2 else (i, b - 1)
        if end[0] < 0:
            break
    return pairs[::-1]


def find(index: Index, words: Words, least: float = LEAST_COVERAGE) -> list[list[tuple]]:
    """Matches of every text of ``words``: what is valid, and wins over all valid matches it overlaps."""
    valid: dict[int, list[tuple]] = {}
    marked, hashes = _fingerprints(words)
    which, template, place = index.hits(hashes)
    at = marked[which]
    row = np.searchsorted(words.first, at, side="right") - 1
    shift = at - words.first[row] - place
    order = np.lexsort((shift, template, row))
    last = None
    for r, k, s in zip(row[order].tolist(), template[order].tolist(), shift[order].tolist()):
        length = len(index.words[k])
        band = max(1, int(BAND * length))
        if last and last[:2] == (r, k) and s - last[2] <= band:
            continue  # a hit near a diagonal already aligned
        last = (r, k, s)
        mine = words.hashes[words.first[r] : words.first[r + 1]]
        lo = max(0, s - 2 * band)
        part = mine[lo : s + length + 2 * band + 1]
        pairs = align(index.words[k], part, s - lo, band)
        if not pairs or not index.versions[k] <= {i for i, _ in pairs}:
            continue
        first, end = lo + pairs[0][1], lo + pairs[-1][1] + 1
        inserted = end - first - len(pairs)
        if len(pairs) >= least * (length + inserted):
            worth = 2 * len(pairs) - (length - len(pairs)) - inserted
            valid.setdefault(r, []).append((-worth, first, end, k, len(pairs), inserted))
    return [_winners(index, words, r, valid.get(r, [])) for r in range(len(words.count))]


def _winners(index: Index, words: Words, r: int, valid: list[tuple]) -> list[tuple]:
    """The best of the valid matches of one text, then the best of those that do not overlap it, and so on.
    Winners are kept in order, so each match looks at its two neighbours only."""
    starts, ends, found = [], [], []
    base, zero = int(words.offsets[r]), int(words.first[r])
    for _, first, end, k, matched, inserted in sorted(valid):
        at = bisect.bisect_left(starts, first)
        if (at and ends[at - 1] > first) or (at < len(starts) and starts[at] < end):
            continue
        starts.insert(at, first)
        ends.insert(at, end)
        span = int(words.begin[zero + first]) - base, int(words.end[zero + end - 1]) - base
        found.append((index.names[k], matched / len(index.words[k]), matched, inserted, *span))
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """``doc_id, n_matches, matches`` for every row; spans are bytes of the UTF-8 text."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = find(index, Words(column(part, "text"), PLAIN), least)
            kind = pa.list_(pa.struct([(f.name, to_arrow[f.dataType.simpleString()]) for f in MATCH.fields]))
            rows = [[dict(zip(MATCH.names, m)) for m in sorted(ms, key=lambda m: (m[4], m[5], m[0]))] for ms in found]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(list(map(len, rows)), pa.int64()), pa.array(rows, kind)],
                ["doc_id", "n_matches", "matches"],
            )

    to_arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_matches", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]
    )
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
