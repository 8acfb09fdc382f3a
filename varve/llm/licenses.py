"""License scan by patience alignment of texts with templates.

Words that are unique both in a stretch of text and in a template are anchors;
the longest run of anchors in the same order is kept and the gaps between them
are aligned alike.  Coverage is the share of the template's words so aligned.

A stretch ends where one of the template's telling words comes again or out of
order, and starts behind the match before it, so that repeated notices are
matched one by one, however close.  Matches of a template don't overlap; where a
stretch gives none, the next telling word starts another.  A template that covers ``least`` or
more must leave a telling word in the text, which makes the first filter exact.

Words of a match stand together: between one telling word and the next may be
``SPREAD`` times the template's length in words, foreign or not; text further
off belongs to another stretch.  That defines a match, at every size of text.

Templates are notices, file headers and, of the shorter licenses, the whole
text; README lists them.  Null and empty texts match nothing, very long ones are
scanned whole, an empty table gives no rows.  Every row has a result of its own,
repeated ones too; matches of several templates over one place (ties included)
are all reported, by start, end and name; extra columns are ignored, whatever
their names.  Spans count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import arrow_map

_PERMISSION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name}General Public License for more details."
)
_GNU = "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."

# fixed values: notices, headers and whole texts as the licenses' stewards word them
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        'appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-header": _PERMISSION,
    "BSD-2-Clause-text": f"{_PERMISSION} {_BSD_ONE} {_BSD_TWO} {_BSD_END}",
    "BSD-3-Clause-text": f"{_PERMISSION} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be "
        "removed or altered from any source distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": f"{_GNU.format(work='program', name='', version=2)} {_GNU_END.format(name='')}".replace("software: you", "software; you"),
    "GPL-3.0-header": f"{_GNU.format(work='program', name='', version=3)} {_GNU_END.format(name='')}",
    "LGPL-2.1-header": f"{_GNU.format(work='library', name='Lesser ', version='2.1')} {_GNU_END.format(name='Lesser ').replace('program', 'library')}",
    "LGPL-3.0-header": f"{_GNU.format(work='program', name='Lesser ', version=3)} {_GNU_END.format(name='Lesser ')}",
    "AGPL-3.0-header": f"{_GNU.format(work='program', name='Affero ', version=3)} {_GNU_END.format(name='Affero ')}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
}
LEAST = 0.8
#: Words between two telling words of a match, at most, as a multiple of the template's length.
SPREAD = 2
_WORD = re.compile(r"[A-Za-z0-9]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str) -> list[str]:
    """Lower-cased words; only ASCII letters change."""
    return _WORD.findall(text.translate(_LOWER))


def _telling(words: list[str], least: float) -> list[str]:
    """Longest distinct words whose places outnumber those that may be missing, so that a match holds one at least."""
    counts = Counter(words)
    spare = len(words) - -(-len(words) * round(least * 100) // 100)
    out, places = [], 0
    for w in sorted(counts, key=lambda w: (-len(w), w)):
        if places > spare:
            break
        out.append(w)
        places += counts[w]
    return out


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned places, rising on both sides."""
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
        one, two = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if two[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if one[w] == 1 and w in place]
        if not anchors:
            continue
        tails: list[int] = []
        at: list[int] = []
        back = [-1] * len(anchors)
        for i, (_, j) in enumerate(anchors):
            k = bisect_left(tails, j)
            back[i] = at[k - 1] if k else -1
            if k == len(tails):
                tails.append(j)
                at.append(i)
            else:
                tails[k], at[k] = j, i
        chain, i = [], at[-1]
        while i >= 0:
            chain.append(anchors[i])
            i = back[i]
        last = (a, c)
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        todo.append((last[0], b, last[1], d))
    return sorted(out)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [(name, own, _telling(own, least)) for name, own in ((n, words_of(t)) for n, t in templates.items()) if own]
        self.telling = {w for _, _, t in self.templates for w in t}

    def _copies(self, words: list[str], hits: list[tuple[int, str]], template: list[str]) -> Iterator[tuple[int, int, int]]:
        """(first place, last place, aligned words) of the template's copies around hits, the places of its telling words."""
        size, counts = len(template), Counter(template)
        place = {w: j for j, w in enumerate(template) if counts[w] == 1}
        k = floor = 0
        while k < len(hits):
            first, word = hits[k]
            last, used, at, turn, n = first, Counter([word]), place.get(word, -1), None, k + 1
            while n < len(hits) and hits[n][0] - last <= SPREAD * size and used[hits[n][1]] < counts[hits[n][1]]:
                last, word = hits[n]
                used[word] += 1
                if turn is None and place.get(word, at) < at:
                    turn = last
                at = max(at, place.get(word, at))
                n += 1
            stop = min(len(words), last + size + 1)
            again = min(stop, hits[n][0]) if n < len(hits) else stop
            starts = {max(floor, first - size), max(floor, hits[k - 1][0] + 1 if k else 0, first - size)}
            best: tuple[int, int, int] | None = None
            for b in (turn, again, stop):
                # a longer stretch wins if it aligns more and starts no later; over a repeated word only where nothing else is found
                if b is None or (best and b == stop != again):
                    continue
                for a in sorted(starts):
                    if sum((Counter(words[a:b]) & counts).values()) < self.least * size:
                        continue
                    pairs = align(words[a:b], template)
                    if len(pairs) >= self.least * size and (best is None or (len(pairs) > best[2] and a + pairs[0][0] <= best[0])):
                        best = (a + pairs[0][0], a + pairs[-1][0], len(pairs))
            k += 1
            if best:
                yield best
                floor = best[1] + 1
                while k < len(hits) and hits[k][0] < floor:
                    k += 1

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) of each match, in order."""
        if not text or self.telling.isdisjoint(present := set(words_of(text))):
            return []
        present &= self.telling
        spans = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
        words = [w for _, _, w in spans]
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in present:
                where.setdefault(w, []).append(i)
        out = []
        for name, template, telling in self.templates:
            hits = sorted((i, w) for w in telling for i in where.get(w, ()))
            for i, j, n in self._copies(words, hits, template):
                out.append((spans[i][0], spans[j][1], name, n / len(template)))
        return sorted(out)


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id and matches (start, end, name, coverage)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("coverage", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("start", "end", "name", "coverage"), m)) for m in scanner.find(t)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow_map, scan, "doc_id long, matches array<struct<start:long,end:long,name:string,coverage:double>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document: doc_id, n_matches, licenses, coverage (the best, 0 without a match), spans."""
    out = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["start"], m["end"]))
    return out.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.name"))), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join(text, ",").alias("spans"),
    )
