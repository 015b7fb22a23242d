"""License scans by patience alignment.

Text and template are word sequences. Words that occur once in both are anchors; the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned in the same way (equal
words at a gap's edges match first). A template's coverage is the share of its words that are matched.

A whole text is scanned in windows a quarter longer than the template, a quarter of it apart, so a license
anywhere, more than once, or in a very long text is found. A window is aligned only if it holds enough words
of the template; with fewer, the coverage can't reach the threshold, so nothing is lost.

The words that name the license (NAMES) must be among the aligned words, next to each other as in the template,
so a notice that differs from another license's in just these words isn't taken for it.

Defined cases: null or wordless text has no license. Repeated rows each get their row. The best license has
the largest coverage, then the longest template, then the first name. An empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# Wording of public licenses and their usual notices, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
        "This work is licensed under a Creative Commons Zero 1.0 Universal License.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}

# What names a license in its own templates; of these phrases, those that a template holds must be matched whole.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "Apache-2.0": ("Apache License", "2.0"),
    "BSD-2-Clause": ("BSD 2-Clause",),
    "BSD-3-Clause": ("BSD 3-Clause",),
    "CC0-1.0": ("CC0", "Creative Commons Zero", "1.0"),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    "Unlicense": ("Unlicense",),
}
_CC_WORDS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
NAMES |= {f"CC-{k}-4.0": (f"CC {k} 4.0", f"Creative Commons {'-'.join(_CC_WORDS[p] for p in k.split('-'))} 4.0") for k in ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA")}
#: A template's place is not this license if these words follow it: the BSD-3-Clause text begins with the whole of BSD-2-Clause.
NOT_BEFORE = {"BSD-2-Clause": "neither the name"}
SHORT = 24


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _place(words: Sequence, phrase: Sequence) -> int:
    """Where phrase first begins in words; -1 if it doesn't."""
    return next((i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase), -1)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest increasing subsequence by the second place; pairs rise by the first (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {b[j]: j for j in range(blo, bhi) if cb[b[j]] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(alo, ahi) if ca[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        out.extend(anchors)
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo.extend((i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:], strict=False))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.names = [name for name in sorted(templates) for _ in templates[name]]
        self.parts = [words_of(t) for name in sorted(templates) for t in templates[name]]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for p in self.parts for w in p}))}
        self.coded = [[self.vocabulary[w] for w in p] for p in self.parts]
        self.times = np.zeros((len(self.parts), len(self.vocabulary)))
        for k, p in enumerate(self.coded):
            np.add.at(self.times[k], p, 1)
        self.phrases = [
            [range(at, at + len(n)) for n in map(words_of, NAMES.get(name, ())) if (at := _place(part, n)) >= 0] for name, part in zip(self.names, self.parts, strict=True)
        ]
        self.not_before = [words_of(NOT_BEFORE.get(name, "")) for name in self.names]
        self.need = np.array([threshold * len(p) - 1e-9 for p in self.parts])

    def _named(self, k: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether each phrase that names template k's license is matched by words next to each other."""
        at = {j: i for i, j in pairs}
        return all(j in at and at[j] - at.get(p[0], -1) == j - p[0] for p in self.phrases[k] for j in p)

    def __call__(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """name, coverage, start, end (code points) and template length of the best place of each template found."""
        places = [m.span() for m in _WORD.finditer(text)]
        get = self.vocabulary.get
        coded = np.fromiter((get(text[i:j].lower(), -1) for i, j in places), dtype=np.int64, count=len(places))
        present = np.zeros(len(self.vocabulary))
        present[coded[coded >= 0]] = 1
        found = []
        for k in np.flatnonzero(self.times @ present >= self.need):
            m = len(self.coded[k])
            inside = np.concatenate([[0], np.cumsum((coded >= 0) & (self.times[k][coded] > 0))])
            step = 1 if m <= SHORT else m // 4  # a window begins at each place where a short notice may
            starts = np.arange(0, max(1, len(coded)), step)
            ends = np.minimum(starts + m + max(2, m // 4), len(coded))
            best = None
            for lo, hi in zip(*(x[inside[ends] - inside[starts] >= self.need[k]] for x in (starts, ends)), strict=True):
                pairs = align(coded[lo:hi].tolist(), self.coded[k])
                if len(pairs) < self.need[k] or best and len(pairs) <= best[0] or not self._named(k, pairs):
                    continue
                after = [text[i:j].lower() for i, j in places[lo + pairs[-1][0] + 1 :][: 8 + len(self.not_before[k])]] if self.not_before[k] else []
                if not after or _place(after, self.not_before[k]) < 0:
                    best = len(pairs), places[lo + pairs[0][0]][0], places[lo + pairs[-1][0]][1]
            if best:
                found.append((self.names[k], best[0] / m, best[1], best[2], m))
        return found


def _scan(templates: dict[str, tuple[str, ...]], threshold: float):
    def work(texts: list[str]) -> dict[str, pa.Array]:
        scanner = _scanner(tuple(sorted(templates.items())), threshold)
        found = [sorted(scanner(text), key=lambda x: (-x[1], -x[4], x[0])) for text in texts]
        best = [f[0] if f else (None, 0.0, None, None) for f in found]
        kinds = {"license": pa.string(), "coverage": pa.float64(), "start": pa.int64(), "end": pa.int64()}
        out = {name: pa.array([b[i] for b in best], kind) for i, (name, kind) in enumerate(kinds.items())}
        return out | {"licenses": pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string())}

    return work


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, tuple[str, ...]], ...], threshold: float) -> Scanner:
    return Scanner(dict(templates), threshold)


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license, coverage, start, end (code points, end exclusive), licenses (all, joined)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return beside(rows, ["doc_id"], _scan(templates, threshold), "doc_id long, license string, coverage double, start long, end long, licenses string")
