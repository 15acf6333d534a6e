"""License scans by conditional compression.

Around each word that speaks of licensing lies a window for every template, as wide as the template is long, whatever
lines or signs of comments stand between. Where most of a template's words occur in its window, the window is compressed
with zstandard alone and with the template as raw dictionary; every template that makes it smaller, or whose words are
all there, is compared word by word. The place with the most words of a template and the fewest differing ones is
reported, then the best of what is left on both sides, until nothing is: ``exact`` where the place holds all words of the
template in order, ``modified`` where it holds most of them.

Edge cases: a null text is the empty text and has no notices; equal places are ranked by the template's name; repeated
rows are reported alike, each for itself; an empty table gives an empty result; repeated notices of a text are each reported; long texts and long lines are
scanned whole; columns other than the named ones are not read.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import heapq
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import rows
from .store import table

#: Fixed wordings: short notices in public use, by license.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        "Released under the ISC License.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "WTFPL": ("This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2.",),
    # The clauses that all of them share.
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
}
_GAP = r"[\W_]+"  # between words: blanks, line breaks, signs of comments
_SPEAKS = re.compile(r"licen[sc]|copyright|\(c\)|©|permission is|all rights reserved|public domain|redistribut|spdx|free software|creative commons|\bcc0\b|\bcc by".replace(" ", _GAP), re.IGNORECASE)
#: The share of a template's words that must be there.
LEAST_SHARE = 0.7
_WORD = re.compile(r"[^\W_]+(?:[.'/-][^\W_]+)*")


class _Template(NamedTuple):
    name: str
    no: int
    held: zstandard.ZstdCompressor
    words: list[str]
    counts: Counter


@functools.lru_cache(maxsize=1)
def _templates() -> list[_Template]:
    out = []
    for name, texts in TEMPLATES.items():
        for no, text in enumerate(texts):
            held = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = [w.lower() for w in _WORD.findall(text)]
            out.append(_Template(name, no, zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False), words, Counter(words)))
    return out


@functools.lru_cache(maxsize=1)
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def compare(words: list[str], template: list[str]) -> tuple[int, int, int, int]:
    """(differing words, words of the template that are there, first, last word of the best place) of a window."""
    runs = [m for m in difflib.SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if m.size]
    best = (len(template), 0, 0, 0)
    for i in range(len(runs)):  # a stray word on either side does not belong to the place
        there = 0
        for m in runs[i:]:
            there += m.size
            first, last = runs[i].a, m.a + m.size
            if there >= LEAST_SHARE * len(template):
                best = min(best, (len(template) + last - first - 2 * there, there, first, last)) if best[1] else (len(template) + last - first - 2 * there, there, first, last)
    return best


class _Found(NamedTuple):
    """A confirmed place: the more of a template is there and the less differs, the better."""

    rank: int
    differing: int
    name: str
    no: int
    first: int
    last: int


class _Text:
    """The words of a text, and the places that a notice can stand in."""

    def __init__(self, text: str):
        self.text = text
        self.words, self.at, self.to = [], [], []
        for m in _WORD.finditer(text):
            self.words.append(m.group().lower())
            self.at.append(m.start())
            self.to.append(m.end())

    def hits(self) -> list[int]:
        """The words at which a text speaks of licensing."""
        last = len(self.words) - 1
        return sorted({min(last, bisect.bisect_right(self.to, m.start())) for m in _SPEAKS.finditer(self.text)}) if self.words else []

    def gain(self, template: _Template, low: int, high: int) -> int:
        """Bytes that the template saves on some words."""
        data = self.text[self.at[low] : self.to[high - 1]].lower().encode()
        return len(_alone().compress(data)) - len(template.held.compress(data))

    def best(self, hit: int, low: int, high: int) -> _Found | None:
        """The best place of any template around a hit, within the words from ``low`` to ``high``."""
        results = []
        for t in _templates():
            n = len(t.words)
            reach = n + n // 2 + 2  # a notice with words put in is longer than its template
            a, b = max(low, hit - reach), min(high, hit + reach + 1)
            own = self.words[a:b]
            there = sum(map(t.counts.__getitem__, t.counts.keys() & own))
            if there < LEAST_SHARE * n or (there < n and self.gain(t, a, b) <= 0):
                continue
            differing, there, first, last = compare(own, t.words)
            if there:
                results.append(_Found(differing - there, differing, t.name, t.no, a + first, a + last))
        return min(results, default=None)


def notices(text: str) -> list[tuple]:
    """(start, end, license, template, reduction, differing words, verdict) of each notice of a text, in order.

    The best place of all is taken first; what it leaves on both sides is judged again.
    """
    if not _SPEAKS.search(text):
        return []
    of = _Text(text)
    taken: list[tuple[int, int]] = []
    out, waiting = [], []

    def judge(hit: int) -> None:
        no = bisect.bisect_right(taken, (hit, len(of.words)))
        if no and taken[no - 1][1] > hit:
            return
        found = of.best(hit, taken[no - 1][1] if no else 0, taken[no][0] if no < len(taken) else len(of.words))
        if found:
            heapq.heappush(waiting, (found, hit))

    for hit in of.hits():
        judge(hit)
    while waiting:
        found, hit = heapq.heappop(waiting)
        no = bisect.bisect_left(taken, (found.last, 0))
        if no and taken[no - 1][1] > found.first:
            judge(hit)
            continue
        taken.insert(no, (found.first, found.last))
        template = next(t for t in _templates() if (t.name, t.no) == (found.name, found.no))
        out.append((of.at[found.first], of.to[found.last - 1], found.name, found.no, of.gain(template, found.first, found.last), found.differing, "modified" if found.differing else "exact"))
        judge(hit)
    return sorted(out)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, license, template, reduction, n_different, verdict): one row for each notice.

    ``reduction`` is in bytes; places are code points, end exclusive.
    """
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for some in rows(batch):
                out = [(doc_id, *f) for doc_id, text in some for f in notices(text)]
                if out:
                    types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "start", "end", "license", "template", "reduction", "n_different", "verdict"])

    return source.mapInArrow(run, f"doc_id {id_type}, start long, end long, license string, template int, reduction int, n_different int, verdict string")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
