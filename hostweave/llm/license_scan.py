"""License texts in documents, found by patience alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Public notices and license texts that are looked for.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "All rights reserved line": "All rights reserved.",  # grants nothing, which a corpus must know too
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
}
COVERAGE = 0.8
# bytes of words: digits and letters, lower-cased, and all of longer characters; the rest is a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first number, in which the second rises too."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1] = [y]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned word positions (text, template), in order.

    Equal words at both ends are aligned first. Between them, words that occur once in the text and
    once in the template are anchors; a longest rising run of anchors is kept, and each gap between
    two of them is aligned in the same way, with what is unique there. A gap without anchors stays
    unaligned.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        seen: dict = {}
        for j in range(c, d):
            seen[template[j]] = -1 if template[j] in seen else j
        once: dict = {}
        for i in range(a, b):
            if seen.get(text[i], -1) >= 0:
                once[text[i]] = -1 if text[i] in once else i
        anchors = rising(sorted((i, seen[w]) for w, i in once.items() if i >= 0))
        if not anchors:
            continue
        out.extend(anchors)
        left = (a - 1, c - 1)
        for right in [*anchors, (b, d)]:
            todo.append((left[0] + 1, right[0], left[1] + 1, right[1]))
            left = right
    return sorted(out)


def find_license(words: list, template: list, coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
    """All places of a template in a text: (first word, word after the last, aligned words).

    A window of one and a half template lengths that holds enough of the template's distinct words
    is aligned, from left to right; where the aligned share of the template reaches ``coverage``, the
    place is reported and the search goes on behind it.
    """
    kinds = set(template)
    need = -(-len(template) * coverage // 1)
    missing = len(template) - need  # so many template words may fail, each at most one kind
    least = max(1, len(kinds) - int(missing))
    places = [i for i, w in enumerate(words) if w in kinds]
    width = len(template) * 3 // 2 + 2
    out: list[tuple[int, int, int]] = []
    held: dict = {}
    right = k = 0
    while k < len(places):
        while right < len(places) and places[right] < places[k] + width:
            held[words[places[right]]] = held.get(words[places[right]], 0) + 1
            right += 1
        ahead = k + 1
        if len(held) >= least:
            start = places[k]
            pairs = patience(words[start : start + width], template)
            # the window begins at its first aligned word, or a later window sees it better
            if len(pairs) >= need and pairs[0][0] == 0:
                end = start + pairs[-1][0] + 1
                out.append((start, end, len(pairs)))
                ahead = bisect_left(places, end)
        while k < min(ahead, right):
            w = words[places[k]]
            held[w] -= 1
            if not held[w]:
                del held[w]
            k += 1
        k, right = ahead, max(right, ahead)
    return out


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per place of a license in a document: id, license, coverage, aligned_words,
    template_words, start_word, end_word (exclusive).

    Words are runs of ASCII letters and digits, A-Z lower-cased, or of other characters. A template
    is aligned only where a text has enough of its words at all. Every document is scanned whole, on
    its own; there is no shuffle.

    Cases: a null, empty or license-free text gives no row; a license that stands twice gives two
    rows; a template that contains another is reported beside it; repeated rows and null ids give
    their own rows; an empty table gives no rows; other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = {name: words_of(text.encode()) for name, text in templates.items()}
    names = ["id", "license", "coverage", "aligned_words", "template_words", "start_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {name: (frozenset(t), len(set(t)) - int(len(t) - -(-len(t) * coverage // 1))) for name, t in parts.items()}
        known = frozenset().union(*(k for k, _ in kinds.values())) if kinds else frozenset()
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text) if text else []
                here = known.intersection(words)
                for name, (k, least) in kinds.items():
                    if here and len(here & k) >= max(1, least):
                        for start, end, n in find_license(words, parts[name], coverage):
                            rows.append(row)
                            found.append((name, n / len(parts[name]), n, len(parts[name]), start, end))
            columns = list(zip(*found)) if found else [()] * 6
            kinds_of = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds_of))], names,
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, license string, coverage double, aligned_words int, template_words int, start_word int, end_word int",
    )
    return out.withColumnRenamed("id", id_col)
