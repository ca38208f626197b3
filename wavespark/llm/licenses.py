"""License scans by conditional compression.

A candidate block surrounds a word that licences use: by the length of the longest template before it, and by twice
that after it, so that it settles all notices that begin up to a template's length behind the word. It is compressed alone and with each template as raw zstandard dictionary: what a template saves tells how much of the
block it explains. Templates are ranked by bytes saved, and the best whose wording really is there wins: an
alignment of words lists what is missing, added or changed. A tenth of a template's words may differ, but not those
with digits (versions), nor may its key words be missing. A template that saves less than LEAST of what it saves on itself
isn't aligned, unless all its key words are there: with a tenth of the words changed it still saves more.

Defined results: texts that are null, empty or without licence words have no rows. A text with several notices has
a row for each: what lies before and after a confirmed notice is searched on. Repeated rows are scanned one by one. Extra
columns are ignored. An empty table gives an empty table. Texts of any length are scanned whole. Of templates that save
equally the first of TEMPLATES wins.

TEMPLATES are notices as files carry them, and the opening terms of short licences; whole texts of long licences count by
the notices in them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

# fixed values: notices as their licences word them; <> stands for a year or names
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "MIT notice 2": "Licensed under the MIT License.",
    "MIT SPDX": "SPDX-License-Identifier: MIT",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 SPDX": "SPDX-License-Identifier: Apache-2.0",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU Affero General Public License for more details.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0 notice": "Released under CC0 1.0.",
    "Proprietary": "Copyright <> All rights reserved.",
}
TRIGGER = r"licen[cs]e|copyright|spdx|hereby granted|permission to use|redistribution and use|free software|source code form|unencumbered|public domain|creative commons|cc by|cc0|permission is granted|express or implied|all rights reserved"
_TRIGGER = re.compile(TRIGGER, re.I)
_WORD = re.compile(r"<>|[^\W_]+(?:[.'-][^\W_]+)*")
#: words that a notice can't do without, beside those with digits
_KEY = frozenset("mit apache gnu gpl mozilla mpl isc bsd by by-sa by-nc by-nd attribution attribution-sharealike cc cc0 spdx-license-identifier redistribution unencumbered reserved lesser affero eclipse neither".split())
DIFFERENT = 0.1
LEAST = 0.3


def words(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


def _needed(word: str) -> bool:
    return word in _KEY or any(c.isdigit() for c in word)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        own = " ".join(self.words).encode()
        found = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=9, dict_data=found)
        self.needs = {w for w in self.words if _needed(w)}
        self.most = len(_alone().compress(own)) - len(self.packer.compress(own))  # what it saves on itself

    def saves(self, block: bytes, alone: int) -> int:
        return alone - len(self.packer.compress(block))


@lru_cache(1)
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9)


@lru_cache(1)
def templates() -> list[Template]:
    return [Template(k, v) for k, v in TEMPLATES.items()]


def align(template: list[str], block: list[str]) -> tuple[int, int, list[str]]:
    """Best place of the template within the block: first and end word, and the differences as -missing or +added.
    A <> takes up to six words for nothing."""
    m, n = len(template), len(block)
    if not n:
        return 0, 0, [f"-{w}" for w in template if w != "<>"]
    ids: dict[str, int] = {}
    b = np.array([ids.setdefault(w, len(ids)) for w in block])
    rows = [np.zeros(n + 1, np.int64)]
    for w in template:
        last = rows[-1]
        if w == "<>":
            now = last.copy()
            for k in range(1, min(6, n) + 1):
                now[k:] = np.minimum(now[k:], last[: n + 1 - k])
        else:
            now = last + 1
            now[1:] = np.minimum(now[1:], last[:-1] + 2 * (b != ids.get(w, -1)))
            at = np.arange(n + 1)
            now = np.minimum.accumulate(now - at) + at
        rows.append(now)
    end = int(np.argmin(rows[m]))
    i, j, out = m, end, []
    while i:
        w, cost = template[i - 1], rows[i][j]
        if w == "<>":
            k = next((k for k in range(min(6, j), -1, -1) if rows[i - 1][j - k] == cost), 0)
            j -= k
            i -= 1
        elif j and block[j - 1] == w and rows[i - 1][j - 1] == cost:
            i, j = i - 1, j - 1
        elif rows[i - 1][j] + 1 == cost and not (_needed(w) and j and rows[i][j - 1] + 1 == cost):  # of equal ways, one that has the key word
            out.append(f"-{w}")
            i -= 1
        else:
            out.append(f"+{block[j - 1]}")
            j -= 1
    return j, end, out[::-1]


def confirmed(template: list[str], differences: list[str]) -> bool:
    wrong = [x for x in differences if x[0] == "-" and _needed(x[1:])]
    return not wrong and len(differences) <= DIFFERENT * len(template)


def _best(own: list[str]) -> tuple[int, int, list[str], Template, int] | None:
    """First and end word, differences, template and bytes saved of the confirmed notice that saves most."""
    block = " ".join(own).encode()
    if not _TRIGGER.search(block.decode()):
        return None
    alone, there = len(_alone().compress(block)), set(own)
    for saved, _, t in sorted(((t.saves(block, alone), k, t) for k, t in enumerate(templates())), key=lambda x: (-x[0], x[1])):
        # what a short notice saves can drown in a long block; then its key words tell
        if saved >= LEAST * t.most or t.needs and t.needs <= there:
            a, b, differences = align(t.words, own)
            if a < b and confirmed(t.words, differences):
                return a, b, differences, t, saved
    return None


def _notices(own: list[str], last: int) -> Iterator[tuple[int, int, list[str], Template, int]]:
    """Notices of the block that begin at word ``last`` or before, in order: the one that saves most, and those on
    either side of it."""
    if best := _best(own):
        a, b, *rest = best
        yield from _notices(own[:a], last)
        if a <= last:
            yield best
        for c, d, *more in _notices(own[b:], last - b):
            yield c + b, d + b, *more


def scan(text: str) -> Iterator[tuple[int, str, int, float, list[str]]]:
    """(offset, licence, bytes saved, share of the template's own saving, differences) of each notice."""
    reach = int(max(len(t.words) for t in templates()) * 1.2 + 10)
    more = _WORD.finditer(text)
    starts, ends, own = [], [], []  # the words read, without those far behind

    def read(enough) -> None:
        while not enough() and (m := next(more, None)):
            starts.append(m.start())
            ends.append(m.end())
            own.append(m[0].lower())
            if len(own) > 8 * reach:
                for x in (starts, ends, own):
                    del x[: -4 * reach]

    done = settled = 0
    for hit in _TRIGGER.finditer(text):
        if hit.start() < settled:
            continue
        read(lambda at=hit.start(): ends and ends[-1] > at)
        for x in (starts, ends, own) if (far := bisect_right(ends, hit.start()) - reach) > 0 else ():
            del x[:far]
        k = bisect_right(ends, hit.start())
        read(lambda k=k: len(own) >= k + 2 * reach)
        low, last = bisect_left(starts, done), k + reach
        settled = ends[last] if last < len(ends) else len(text)
        for a, b, differences, t, saved in _notices(own[low : k + 2 * reach], last - low):
            yield starts[low + a], t.name, saved, round(saved / t.most, 4), differences
            done = ends[low + b - 1]
        settled = max(settled, done)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, at, license, saved, share and differences (JSON) of each notice."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pc.fill_null(pc.match_substring_regex(b.column(1), TRIGGER, ignore_case=True), False))
            at, rows = [], []
            for k, text in enumerate(some.column(1).to_pylist()):
                for r in scan(text):
                    at.append(k)
                    rows.append((*r[:4], json.dumps(r[4], ensure_ascii=False)))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["doc_id", "at", "license", "saved", "share", "differences"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at long, license string, saved int, share double, differences string")
