"""License scans by wording differences and conditional compression.

Every notice of every template is looked for at every word of a text. The words of a notice that a span lacks and those that it adds
may together be at most `tolerance` of the notice, counted exactly: what is left of both after their longest common
subsequence of words. A notice that may lack `most` words has the most + 1 longest of its words as cues, one of which
is in every such span; the words about a cue, as many as a span can have, are a candidate block if enough of them are
words of the notice. Blocks run across lines and comment marks, and those that touch are one.

Conditional compression. A block, in lower case like the templates, is compressed alone and with each template as a raw zstandard dictionary; the
templates are ranked by how much smaller the block gets. In that order their notices are confirmed by
the exact differences of wording, and a confirmed span must itself get smaller with its template. No template is
left out for its rank. All confirmed notices that do not overlap are reported; of those that do, the one with the most
words above twice its differences, then that of the better rank, then the one that begins first.

Null, blank and empty texts have no blocks; very long ones are searched whole, block by block. Repeated rows, and rows
of one doc_id, are searched each by itself; null doc_ids stay null; texts without a notice, and an empty table, give no
rows. Ties go to the template of the lesser name. Columns beside doc_id and text are not read, whatever their
names. Offsets are code points, ends exclusive. `rank` is 1 for the template that compresses the block best.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import text_of

#: Notices and texts of public licenses by name; pass others as a parameter.
NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
MIT_REST = ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
APACHE_REST = ' You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GPL_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", APACHE, APACHE + APACHE_REST, "SPDX-License-Identifier: Apache-2.0"),
    "bsd-2-clause": (BSD + BSD_TWO + BSD_END, "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "bsd-3-clause": (BSD, BSD + BSD_TWO + BSD_THREE + BSD_END, "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", GPL.format(2), GPL.format(2) + GPL_END, "SPDX-License-Identifier: GPL-2.0-only"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", GPL.format(3), GPL.format(3) + GPL_END, "SPDX-License-Identifier: GPL-3.0-only"),
    "isc": (ISC, ISC + ISC_END, "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl-2.1": (LGPL.format("2.1"), "SPDX-License-Identifier: LGPL-2.1-only"),
    "lgpl-3.0": (LGPL.format(3), "SPDX-License-Identifier: LGPL-3.0-only"),
    "mit": ("Released under the MIT License.", MIT, MIT + MIT_REST + NO_WARRANTY, "SPDX-License-Identifier: MIT"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
}
TERMS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


@dataclass
class Notice:
    name: str
    words: list[str]
    most: int
    count: Counter = field(init=False)
    cues: set[str] = field(init=False)
    number: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.count = Counter(self.words)
        # of so many places one at least is matched by a span within the tolerance
        longest = sorted(range(len(self.words)), key=lambda k: (-len(self.words[k]), k))[: self.most + 1]
        self.cues = {self.words[k] for k in longest}
        self.number = {w: k for k, w in enumerate(dict.fromkeys(self.words))}
        self.row = np.array([self.number[w] for w in self.words])

    @property
    def reach(self) -> int:
        """Words of a span at most."""
        return len(self.words) + self.most

    def windows(self, have: list[str], lo: int, hi: int) -> list[tuple[int, int]]:
        """Stretches of the words lo to hi in which every span lies: of as many words, enough are those of the notice."""
        left, common, out = Counter(self.count), 0, []
        least = len(self.words) - self.most
        for end in range(lo, hi):
            if have[end] in left:
                left[have[end]] -= 1
                common += left[have[end]] >= 0
            gone = end - self.reach
            if gone >= lo and have[gone] in left:
                left[have[gone]] += 1
                common -= left[have[gone]] > 0
            if common >= least:
                first = max(lo, gone + 1)
                if out and first <= out[-1][1]:
                    out[-1] = out[-1][0], end + 1
                else:
                    out.append((first, end + 1))
        return out

    def spans(self, have: list[str], lo: int, hi: int) -> list[tuple[int, int, int]]:
        """Words lacking and added, first and last (exclusive) of the best span that ends at each word, if within the tolerance.

        The best has fewest differences, then fewest words. A column holds, for each beginning of the notice, the differences
        times `unit` less the start of the span, so one minimum serves both.
        """
        n, unit = len(self.words), hi - lo + 2
        steps = np.arange(n + 1) * unit
        column, out = steps.copy(), []
        get = self.number.get
        for end in range(lo, hi):
            word = get(have[end], -1)
            new = column + unit
            if word >= 0:
                np.minimum(new[1:], np.where(self.row == word, column[:-1], new[1:]), out=new[1:])
            new[0] = lo - end - 1
            column = np.minimum.accumulate(new - steps) + steps
            differ = -(-int(column[n]) // unit)
            if differ <= self.most and word >= 0:
                out.append((differ, lo + differ * unit - int(column[n]), end + 1))
        return out


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], tolerance: float = 0.1):
        import zstandard as z

        self.alone = z.ZstdCompressor(level=12)
        self.given = {name: z.ZstdCompressor(level=12, dict_data=z.ZstdCompressionDict("\n".join(notices).lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for name, notices in templates.items()}
        self.notices = []
        for name, notices in sorted(templates.items()):
            for words in ([w.lower() for w in TERMS.findall(n)] for n in notices):
                if words:
                    self.notices.append(Notice(name, words, min(int(tolerance * len(words)), len(words) - 1)))
        self.cues = set().union(*[n.cues for n in self.notices])
        self.gain = lru_cache(20_000)(self._gain)

    def _gain(self, span: str, name: str) -> float:
        raw = span.lower().encode()
        return 1 - len(self.given[name].compress(raw)) / len(self.alone.compress(raw))

    def ranked(self, block: str) -> list[str]:
        """The templates by how much smaller a block gets with each as its dictionary, the best first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        return sorted(self.given, key=lambda name: (len(self.given[name].compress(raw)), name))

    def candidates(self, have: list[str]) -> list[tuple[Notice, int, int]]:
        """Notices with the stretches of words in which their spans lie."""
        places: dict[str, list[int]] = {}
        for k, w in enumerate(have):
            if w in self.cues:
                places.setdefault(w, []).append(k)
        out = []
        for notice in self.notices:
            at = sorted(k for w in notice.cues if w in places for k in places[w])
            around: list[list[int]] = []
            for k in at:
                lo, hi = max(0, k - notice.reach + 1), min(len(have), k + notice.reach)
                if around and lo <= around[-1][1]:
                    around[-1][1] = hi
                else:
                    around.append([lo, hi])
            out += [(notice, a, b) for lo, hi in around for a, b in notice.windows(have, lo, hi)]
        return out

    def judge(self, text: str) -> list[tuple[str, float, int, int, int, int, int]]:
        """license, gain, start, end, words lacking and added, and rank of every confirmed notice of a text."""
        if self.cues.isdisjoint(map(str.lower, TERMS.findall(text))):
            return []
        spots = [(m.start(), m.end()) for m in TERMS.finditer(text)]
        have = [text[a:b].lower() for a, b in spots]
        blocks: list[tuple[int, int, list]] = []
        for notice, a, b in sorted(self.candidates(have), key=lambda x: x[1:]):
            if blocks and a <= blocks[-1][1]:
                lo, hi, own = blocks[-1]
                blocks[-1] = lo, max(hi, b), [*own, (notice, a, b)]
            else:
                blocks.append((a, b, [(notice, a, b)]))
        out = []
        for lo, hi, own in blocks:
            rank = {name: k for k, name in enumerate(self.ranked(text[spots[lo][0] : spots[hi - 1][1]]), 1)}
            found = [(2 * differ - len(n.words), rank[n.name], n.name, first, last, differ, len(n.words)) for n, a, b in own for differ, first, last in n.spans(have, a, b)]
            taken = np.zeros(hi - lo, bool)
            for _, place, name, first, last, differ, size in sorted(found):
                if taken[first - lo : last - lo].any():
                    continue
                start, end = spots[first][0], spots[last - 1][1]
                gain = self.gain(text[start:end], name)
                if gain > 0:
                    taken[first - lo : last - lo] = True
                    same = (size + last - first - differ) // 2
                    out.append((name, round(gain, 6), start, end, size - same, last - first - same, place))
        return sorted(out, key=lambda x: (x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, tolerance: float = 0.1) -> DataFrame:
    """A row for each confirmed notice: doc_id, license, start, end, gain, lacking, added, rank."""
    templates = TEMPLATES if templates is None else templates
    names = ["doc_id", "license", "start", "end", "gain", "lacking", "added", "rank"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, tolerance)
        for b in batches:
            out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in ((name, start, end, gain, *rest) for name, gain, start, end, *rest in scanner.judge(t))]
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(find, "doc_id long, license string, start long, end long, gain double, lacking long, added long, rank long")
