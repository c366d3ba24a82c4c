"""License scans by patience alignment of texts with license templates.

A text and a template are aligned as patience diff does: words that are unique in
both are anchors, the longest increasing subsequence of their places is kept, and
the gaps between anchors are aligned in the same way; where a gap has no anchor,
equal words at its two ends count.  The share of the template's words that is
aligned is its coverage; from `threshold` on the license is found.

A template's occurrences are found one by one.  A text that covers so much of a template
must bear one of any (1 - threshold) L + 1 of its words; the rarest of these are looked
for, and each place of one tells where the template would begin.  Around the beginnings
that most words agree on, spans of about one template length are aligned (up to half a
length more, for words put in), and what is found is passed over from then on, so
repeated notices don't blur each other.  Texts without any of the words are passed over.

Where spans of several templates overlap, the one with the most words aligned counts,
then the one that is covered better: a notice of "CC BY-NC" isn't one of "CC BY".

Defined cases.  Null or empty text: no license, coverage 0.  Of several licenses in a
text the one with the greatest coverage, then the longest, then the first by name, is
the best; "All rights reserved" comes after all licenses.  Very long text: work grows
with the text and the places of rare words in it.  Repeated rows and null ids: each row
on its own.  Empty table: no rows.  Extra and clashing columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")

# Wording of common licenses and notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
        " specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
        " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
        " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE"
        " IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
        " WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
        " with the distribution."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
        " License for more details."
    ),
    "GPL-2.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
        " License for more details."
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public"
        " License for more details."
    ),
    "LGPL-2.1": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
        " License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public"
        " License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public"
        " License for more details."
    ),
    "GPL-3.0 text": (
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not"
        " allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."
    ),
    "GPL-2.0 text": (
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU"
        " General Public License is intended to guarantee your freedom to share and change free software--to make sure the"
        " software is free for all its users."
    ),
    "LGPL-3.0 text": (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU"
        " General Public License, supplemented by the additional permissions listed below."
    ),
    "AGPL-3.0 text": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,"
        " specifically designed to ensure cooperation with the community in the case of network server software."
    ),
    "Apache-2.0 text": (
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and"
        " conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"
        " which is available at http://www.eclipse.org/legal/epl-2.0"
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission."
    ),
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "All rights reserved": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


#: Found beside licenses too, so the best only where nothing else is found.
LAST = "All rights reserved"


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, that rises in the second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the words that a patience alignment pairs."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        if anchors:
            found += anchors
            for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                todo.append((p + 1, r, q + 1, s))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
    return sorted(found)


class Scanner:
    """Templates prepared for a threshold of coverage."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8):
        self.threshold = threshold
        self.templates = {name: words_of(t.encode()) for name, t in sorted(templates.items())}
        used = Counter(w for t in self.templates.values() for w in set(t))
        self.seeds: dict[bytes, set[str]] = defaultdict(set)
        for name, t in self.templates.items():
            # A window that covers enough bears one of these: so many words can't be missing.
            spare, taken = len(t) - ceil(threshold * len(t)), 0
            of = Counter(t)
            for w in sorted(of, key=lambda w: (used[w], -len(w), w)):
                self.seeds[w].add(name)
                taken += of[w]
                if taken > spare:
                    break
        self.any = re.compile(b"|".join(re.escape(w) for w in sorted(self.seeds, key=len, reverse=True)))

    def _occurrences(self, name: str, words: list[bytes], seen: list[int]):
        """(words aligned, first word, last word) of the template's occurrences; `seen` has the places of its rare words."""
        template = self.templates[name]
        size, of = len(template), Counter(template)
        least = ceil(self.threshold * size)
        # Words strewn over a wide stretch of text are no notice.
        drift = max(0, min(max(3, size // 2), size - 2))
        at: dict[bytes, list[int]] = defaultdict(list)
        for j, w in enumerate(template):
            if name in self.seeds.get(w, ()):
                at[w].append(j)
        votes = Counter(i - j for i in seen for j in at[words[i]])
        taken: list[tuple[int, int]] = []  # sorted, disjoint

        def free(begin: int, end: int) -> tuple[int, int]:
            """The part of a span around its middle that no occurrence has taken."""
            k = bisect_left(taken, ((begin + end) // 2, 0))
            if k and taken[k - 1][1] > begin:
                begin = taken[k - 1][1]
            if k < len(taken) and taken[k][0] < end:
                end = taken[k][0]
            return begin, end

        # Beginnings that most rare words agree on first.
        for begin, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            best = None
            for d in sorted({0, size // 8, size // 4, drift}):
                a, b = free(max(0, begin - d), min(len(words), begin + size + d))
                held = Counter(words[a:b])
                if sum(min(n, held[w]) for w, n in of.items()) < least:
                    continue
                pairs = align(words[a:b], template)
                middle = pairs[len(pairs) // 2] if pairs else (0, 0)
                near = [p for p in pairs if abs((p[0] - middle[0]) - (p[1] - middle[1])) <= drift]
                if len(near) >= least and (best is None or len(near) > best[0]):
                    best = (len(near), a + near[0][0], a + near[-1][0])
                    if best[0] == size:
                        break
            if best:
                insort(taken, (best[1], best[2] + 1))
                yield best

    def occurrences(self, words: list[bytes]) -> list[tuple[float, str, int, int]]:
        """(coverage, license, first word, last word) in the order of the text; spans don't overlap."""
        places: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            for name in self.seeds.get(w, ()):
                places[name].append(i)
        found = [
            (n, n / len(self.templates[name]), name, first, last)
            for name, seen in places.items()
            for n, first, last in self._occurrences(name, words, seen)
        ]
        kept: list[tuple[int, int, float, str]] = []
        for n, share, name, first, last in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            k = bisect_left(kept, (first,))
            if (k == 0 or kept[k - 1][1] < first) and (k == len(kept) or kept[k][0] > last):
                kept.insert(k, (first, last, share, name))
        return [(share, name, first, last) for first, last, share, name in kept]

    def scan(self, text: bytes) -> list[tuple[float, str, int, int]]:
        """(coverage, license, first word, last word) of each license's best occurrence, best first."""
        if not self.any.search(text.lower()):
            return []
        best: dict[str, tuple[float, str, int, int]] = {}
        for found in self.occurrences(words_of(text)):
            if found[1] not in best or found[0] > best[found[1]][0]:
                best[found[1]] = found
        return sorted(best.values(), key=lambda x: (x[1] == LAST, -x[0], -len(self.templates[x[1]]), x[1]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, license (best), coverage, first_word, last_word, licenses (all)."""
    scanner = Scanner(templates, threshold)
    kind = "struct<license:string,coverage:double,first_word:bigint,last_word:bigint,licenses:array<string>>"

    @F.arrow_udf(kind)
    def look(column: pa.Array) -> pa.Array:
        rows = []
        for x in column.cast(pa.large_binary()):
            found = scanner.scan(bytes(x.as_buffer())) if x.is_valid else []
            c, name, first, last = found[0] if found else (0.0, None, None, None)
            rows.append((name, c, first, last, [f[1] for f in found]))
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        names = ["license", "coverage", "first_word", "last_word", "licenses"]
        columns = zip(*rows) if rows else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", look(F.col("text")).alias("l")).select("doc_id", "l.*")


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "license", "coverage", "first_word", "last_word", F.array_join("licenses", "; ").alias("licenses"))
