"""Licence scan: passages compared to licence templates by Dice coefficient over word bigrams.

Texts are normalised to lower-case words. Word bigrams that occur in a template are located in a document; a passage is a
stretch between two of them. With threshold t and a template of b bigrams, a passage must have between b t / (2 - t) and
b (2 - t) / t bigrams, and the document at least b t / (2 - t) of the template's; both bounds prune before any comparison.

Licences contain each other's clauses and notices, or differ in few words. Of overlapping passages the one with the largest
agreement is taken: bigrams shared with its template, less those that only one of both has. So a whole licence wins over the
notice in its appendix, three clauses win over the first two, and the nearest of several versions wins.
"""

from __future__ import annotations

import heapq
import pkgutil
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, batch, map_batches, table
from graphloom.llm.decontaminate import words

THRESHOLD = 0.8

#: Licences whose full text is a template, from licence_texts/.
FULL = ["AGPL-3.0", "Apache-1.1", "Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense"]

_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""
_BSD_AD = """All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software
        developed by the organization."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission."""
_BSD_NO_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, what: str = "program", mark: str = ";") -> str:
    """The notice by which the Free Software Foundation's licences are applied."""
    return f"""This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software
        Foundation{mark} either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful,
        but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} License for more
        details."""


#: Fixed texts: licence statements and licences, by identifier; a licence may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
        a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("BSD-2-Clause", _BSD_TWO),
    ("BSD-2-Clause", f"{_BSD_TWO} {_BSD_NO_WARRANTY}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", f"{_BSD_TWO} 3. {_BSD_NAME}"),
    ("BSD-3-Clause", f"{_BSD_TWO} 3. {_BSD_NAME} {_BSD_NO_WARRANTY}"),
    ("BSD-4-Clause", f"{_BSD_TWO} 3. {_BSD_AD} 4. {_BSD_NAME}"),
    ("BSD-4-Clause", f"{_BSD_TWO} 3. {_BSD_AD} 4. {_BSD_NAME} {_BSD_NO_WARRANTY}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("General Public", "3", mark=",")),
    ("GPL-2.0", _gnu("General Public", "2")),
    ("GPL-1.0", _gnu("General Public", "1")),
    ("LGPL-3.0", _gnu("Lesser General Public", "3", "library")),
    ("LGPL-3.0", _gnu("Lesser General Public", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public", "2.1", "library")),
    ("LGPL-2.1", _gnu("Lesser General Public", "2.1")),
    ("LGPL-2.0", _gnu("Library General Public", "2", "library")),
    ("LGPL-2.0", _gnu("Library General Public", "2")),
    ("AGPL-3.0", _gnu("Affero General Public", "3")),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "MPL-1.1",
        """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT
        WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.""",
    ),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES += [(name, (pkgutil.get_data("graphloom.llm", f"licence_texts/{name}.txt") or b"").decode()) for name in FULL]


@dataclass
class Match:
    """A passage, as first and last word, that resembles a template."""

    license: str
    first: int
    last: int
    dice: float


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.names = threshold, [name for name, _ in templates]
        texts = [words(t.encode()) for _, t in templates]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.base = len(self.vocabulary) + 1
        self.grams = [np.unique(self._codes(self._ids(t))) for t in texts]
        self.all = np.unique(np.concatenate(self.grams))
        self.least = np.array([len(g) * threshold / (2 - threshold) for g in self.grams])
        self.most = np.array([len(g) * (2 - threshold) / threshold for g in self.grams])
        self.holds = np.stack([np.isin(self.all, g) for g in self.grams], 1)  # by bigram and template

    def _ids(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in found], np.int64)

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of consecutive pairs; unknown words make a pair that is in no template."""
        return np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], -1)

    def scan(self, text: bytes) -> list[Match]:
        """Passages by first word, none overlapping another. Of a template's passages the one with the largest coefficient
        comes first, then the longer, then the earlier; of several templates' first ones that with the largest agreement
        is taken, then the longer, the earlier, the first template's."""
        found = words(text)
        codes = self._codes(self._ids(found))
        at = np.flatnonzero(codes > 0)
        place = np.minimum(np.searchsorted(self.all, codes[at]), len(self.all) - 1)
        same = self.all[place] == codes[at]
        at, place = at[same], place[same]
        hits = self.holds[np.unique(place)].sum(0) if len(at) else np.zeros(len(self.grams))
        likely = np.flatnonzero(hits >= self.least - 1e-9)
        if not len(likely):
            return []
        passages, taken = self._passages(likely.tolist(), at, place, found), np.zeros(len(found), bool)

        def free(k: int, rest: Iterator[tuple[float, int, int, int]]) -> None:
            """The next passage of a template that overlaps none taken joins the heap."""
            for dice, less, a, z in rest:
                if not taken[a : z + 2].any():
                    heapq.heappush(heap, (less, a - z, a, k, z, -dice, rest))
                    return

        heap: list[tuple] = []
        for k in likely:
            free(int(k), iter(sorted(passages[k])))
        out: list[Match] = []
        while heap:
            _, _, a, k, z, dice, rest = heapq.heappop(heap)
            if not taken[a : z + 2].any():
                taken[a : z + 2] = True
                out.append(Match(self.names[k], a, z + 1, dice))
            free(k, rest)
        return sorted(out, key=lambda m: m.first)

    def _passages(self, likely: list[int], at: np.ndarray, place: np.ndarray, found: list[bytes]) -> dict[int, list[tuple[float, int, int, int]]]:
        """(-coefficient, -agreement, first bigram, last bigram) of the best passage from each bigram of each likely
        template. at and place: template bigrams in the document. Goes through the bigrams backwards and keeps the first
        places of all distinct ones from there on; only at these does a passage's size grow, whatever its number of words."""
        end = int(at[-1]) + 1
        firsts, f = np.empty(end, np.int64), end
        mine = {k: at[self.holds[place, k]] for k in likely}
        member = {k: np.isin(np.arange(end), mine[k]) for k in likely}
        starts: dict[int, list[int]] = {}
        for k in likely:
            for a in mine[k][: max(0, len(mine[k]) - int(np.ceil(self.least[k] - 1e-9)) + 1)].tolist():
                starts.setdefault(a, []).append(k)
        out: dict[int, list[tuple[float, int, int, int]]] = {k: [] for k in likely}
        after: dict[tuple[bytes, bytes], int] = {}
        for a in range(end - 1, min(starts, default=end) - 1, -1):
            pair = found[a], found[a + 1]
            again = after.get(pair)
            after[pair] = a
            if again is None:
                f -= 1
            else:
                j = f + int(np.searchsorted(firsts[f:], again))
                firsts[f + 1 : j + 1] = firsts[f:j]
            firsts[f] = a
            for k in starts.get(a, []):
                n, most = len(self.grams[k]), int(self.most[k] + 1e-9)
                shared = np.cumsum(member[k][firsts[f : f + most]])
                size = np.arange(1, len(shared) + 1)
                dice = 2 * shared / (size + n)
                good = np.flatnonzero((size >= self.least[k] - 1e-9) & (dice >= self.threshold - 1e-9))
                if len(good):
                    j = good[np.flatnonzero(dice[good] == dice[good].max())[-1]]
                    grows = firsts[f + j + 1] if f + j + 1 < end else end
                    z = mine[k][np.searchsorted(mine[k], grows) - 1]
                    out[k].append((-float(dice[j]), int(size[j] + n - 3 * shared[j]), a, int(z)))
        return out


@lru_cache(4)
def scanner(threshold: float = THRESHOLD) -> Scanner:
    return Scanner(TEMPLATES, threshold)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, matches: array of (license, first, last, dice)) for each row of docs, row by row without shuffle. Null and
    empty texts have no matches; repeated rows stay."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("dice", pa.float64())]))
        return batch(doc_id=b.column(0), matches=pa.array([[vars(m) for m in scanner(threshold).scan(t)] for t in as_bytes(b.column(1))], kind))

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, matches array<struct<license: string, first: long, last: long, dice: double>>"
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its number of licence passages, the distinct licences, sorted and comma-joined, and the best score."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("matches.dice"), F.lit(0.0)), 6).alias("best_dice"),
    )
