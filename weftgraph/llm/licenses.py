"""License scans: patience alignment of texts with license templates.

Words are runs of a-z and 0-9 of the lower-case text. A template is aligned with a window of the
text: words that occur once in both are anchors, the longest increasing sequence of them is taken,
and the gaps between anchors are aligned again in the same way, after equal words at their ends have
been matched. The coverage is the share of the template's words that are matched; a license is found
where it reaches ``LEAST`` and the matched stretch isn't longer than ``STRETCH`` times the template.

Windows: a find must have one of the template's ``len - need + 1`` rarest words of the text, whatever
words it lacks; so windows around the places of these words miss no find. Documents that don't have
``need`` of a template's words can't hold it and are not aligned.

Null and empty texts hold nothing. Very long texts are scanned whole. Of equally covered templates
the longer, then the first in the list, is the best; of a template's finds the one that matches most words, then the
shortest, then the first. Finds of one template don't overlap. Repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, STRETCH = 0.8, 2
_WORD = re.compile(r"[a-z0-9]+")

#: Notices and texts of licenses, as their publishers word them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
        Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
        Public License for more details.""",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose seconds increase: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
        back[k] = at[pile - 1] if pile else -1
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions in both word lists, increasing; by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a.get(w) == 1}
        anchors = _increasing([(x, place[w]) for x, w in enumerate(a[i:j], i) if w in place])
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)]):
            if x + 1 < x2 and y + 1 < y2:
                todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float = LEAST):
        self.name, self.words = name, words(text)
        self.counts = Counter(self.words)
        self.need = -(-len(self.words) * round(least * 1000) // 1000)
        self.distinct_need = max(1, len(self.counts) - (len(self.words) - self.need))

    def finds(self, text: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """matched words, first and last+1 word of each find in a text.

        Of overlapping finds the best stays; what lies between finds is searched again.
        """
        have = sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items())
        if have < self.need:
            return []
        rare = sorted(self.words, key=lambda w: len(places.get(w, ())))[: len(self.words) - self.need + 1]
        near = STRETCH * len(self.words)
        windows: list[list[int]] = []
        for p in sorted({p for w in set(rare) for p in places.get(w, ())}):
            if windows and p - near <= windows[-1][1]:
                windows[-1][1] = p + near
            else:
                windows.append([p - near, p + near])
        out = []
        todo = [(max(0, lo), min(len(text), hi)) for lo, hi in windows]
        while todo:
            lo, hi = todo.pop()
            met = set()
            for start, end in self._parts(lo, hi):
                pairs = self._nearest(align(text[start:end], self.words), near)
                if len(pairs) >= self.need:
                    first, last = start + pairs[0][0], start + pairs[-1][0] + 1
                    met.add((-len(pairs), last - first, first))
            firsts: list[int] = []
            lasts: list[int] = []
            for n, long, first in sorted(met):
                k = bisect_left(firsts, first)
                if (k == 0 or lasts[k - 1] <= first) and (k == len(firsts) or first + long <= firsts[k]):
                    firsts.insert(k, first)
                    lasts.insert(k, first + long)
                    out.append((-n, first, first + long))
            if firsts:
                todo += [(x, y) for x, y in zip([lo, *lasts], [*firsts, hi]) if y - x >= self.need]
        return out

    @staticmethod
    def _nearest(pairs: list[tuple[int, int]], near: int) -> list[tuple[int, int]]:
        """The most pairs, the first of as many, within ``near`` words of the text: matches of words around a find don't hide it."""
        a = b = i = 0
        for j in range(len(pairs)):
            while pairs[j][0] + 1 - pairs[i][0] > near:
                i += 1
            if j + 1 - i > b - a:
                a, b = i, j + 1
        return pairs[a:b]

    def _parts(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """A window as it is, if it is short; a long one (many finds in a row) in overlapping parts too, each find whole in one."""
        size = 2 * STRETCH * len(self.words)
        if hi - lo <= 2 * size:
            yield lo, hi
        step = len(self.words)
        if hi - lo > step:
            stride = max(1, step // 2)
            for start in range(lo, hi, stride):
                yield start, min(hi, start + STRETCH * step + stride)


_COMPILED: dict[tuple, tuple[list[Template], frozenset]] = {}


def scan(text: str | None, templates: dict[str, str] = TEMPLATES) -> list[tuple[str, float, int, int]]:
    """License, coverage, first and last+1 code point of each find of a text, the best first."""
    key = tuple(templates.items())
    if key not in _COMPILED:
        compiled = [Template(n, t) for n, t in key]
        _COMPILED[key] = compiled, frozenset(w for t in compiled for w in t.words)
    compiled, vocabulary = _COMPILED[key]
    if not text:
        return []
    lower = text.lower()
    present = vocabulary.intersection(_WORD.findall(lower))
    likely = [t for t in compiled if sum(w in present for w in t.counts) >= t.distinct_need]
    if not likely:
        return []
    spans = [m.span() for m in _WORD.finditer(lower)]
    listed = [lower[a:b] for a, b in spans]
    places: dict[str, list[int]] = {}
    for i, w in enumerate(listed):
        if w in vocabulary:
            places.setdefault(w, []).append(i)
    found = []
    for k, t in enumerate(likely):
        for n, first, last in t.finds(listed, places):
            found.append((-n / len(t.words), -len(t.words), k, last - first, first, t.name, spans[first][0], spans[last - 1][1]))
    return [(name, -c, a, b) for c, _, _, _, _, name, a, b in sorted(found)]


_SCHEMA = "doc_id long, license string, coverage double, start_char long, end_char long, n_found long, licenses array<string>"


def scan_documents(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, the best license with its coverage and span (null if none), the number of finds and all licenses found, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for text in part.column(1).to_pylist():
                    found = scan(text, templates)
                    rows.append((*(found[0] if found else (None,) * 4), len(found), list(dict.fromkeys(f[0] for f in found))))
                types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=["doc_id", "license", "coverage", "start_char", "end_char", "n_found", "licenses"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
