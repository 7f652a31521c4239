"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

Texts and templates are read as five-word shingles.  Windows of two sizes slide
over a text, the next beginning before the last ends; every window position of a
template is indexed, so an unchanged copy of a template holds at least one
window that equals an indexed one.  A window's MinHash signature, 16 bands of 2
rows, meets that of a window with Jaccard similarity s in some band with
probability 1 - (1 - s^2)^16, over 0.9999999 at s = 0.8.  Templates too short
for a window of shingles are found by single shingles.  A template that is met
is then measured on its whole surroundings: the share of its distinct shingles
that occur there must reach the threshold.  SPDX lines are found by their words.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import column_of, extended
from .textarrays import ALNUM, Words, blocks, mix, ngram_hashes, words

SHINGLE = 5
BANDS, ROWS = 16, 2
#: (words of a window, words to the next window's begin); a template of at least their sum less one holds a whole window.
SIZES = ((64, 32), (16, 8), (5, 1))

#: Public license notices by SPDX id (and "-line" for one-line statements).
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "LGPL-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following""",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

#: Licenses with their full text in license_texts; reported by id and "-text".
FULL_TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")

#: Ids that are read after "SPDX-License-Identifier:"; reported by id and "-spdx".
SPDX_IDS = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC
LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0
MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MulanPSL-2.0 NCSA OFL-1.1 OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0
Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()


def inventory() -> dict[str, str]:
    """TEMPLATES and the full texts."""
    return TEMPLATES | {f"{x}-text": pkgutil.get_data(__package__, f"license_texts/{x}.txt").decode() for x in FULL_TEXTS}


def _word_hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM).hash.tolist()


class Tags:
    """Finds SPDX lines by their words: the tag, then ids that or, and or with join."""

    def __init__(self, ids: Sequence[str]):
        self.tag = np.array(_word_hashes("SPDX-License-Identifier"), np.uint64)
        self.ids = {tuple(_word_hashes(x)): f"{x}-spdx" for x in ids}
        self.sizes = sorted({len(x) for x in self.ids}, reverse=True)
        self.joints = set(_word_hashes("or and with"))

    def matches(self, w: Words) -> list[list[tuple[str, int, int, float]]]:
        """For each text (id, first word, word after the last, 1.0); the first id's place has the tag."""
        out: list[list] = [[] for _ in w.counts]
        at = np.flatnonzero(w.hash == self.tag[0])
        for k in range(1, len(self.tag)):
            at = at[at + k < len(w.hash)]
            at = at[w.hash[at + k] == self.tag[k]]
        for begin in at.tolist():
            text = int(np.searchsorted(w.first, begin, "right")) - 1
            base, stop = int(w.first[text]), int(w.first[text + 1])
            start, end = begin, begin + len(self.tag)
            while size := next((n for n in self.sizes if end + n <= stop and tuple(w.hash[end : end + n].tolist()) in self.ids), 0):
                out[text].append((self.ids[tuple(w.hash[end : end + size].tolist())], start - base, end + size - base, 1.0))
                start = end = end + size + 1
                if end > stop or int(w.hash[end - 1 : end].sum()) not in self.joints:
                    break
        return out


_rng = np.random.default_rng(77)
_SEEDS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _band_keys(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For windows h[begin:end] their band keys, one row a window."""
    out = np.empty((len(begin), BANDS), np.uint64)
    if not len(begin):
        return out
    cuts = np.stack([begin, np.minimum(end, len(h))], 1).ravel()
    padded = np.append(h, np.uint64(2**64 - 1))
    for band in range(BANDS):
        key = np.full(len(begin), band, np.uint64)
        for row in range(ROWS):
            value = (padded ^ (padded >> np.uint64(29))) * _SEEDS[band * ROWS + row]
            value ^= value >> np.uint64(32)
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, cuts)[::2]
        out[:, band] = mix(key)
    return out


def _places(at: list[int], of: list[int], times: dict[int, int], reach: int, threshold: float) -> list[tuple[int, int, float]]:
    """(first, last, share) of the stretches that hold enough of a template's shingles, from left to right, none overlapping.

    at: where shingles of the template stand; of: their places in the template;
    times: how often the template has the shingle of a place.  The first stretch to hold enough sets which copy is read; of
    the stretches that begin in it and are made of whole runs of the template,
    that with the most shingles, less those beyond the template's own, is taken, so a
    copy isn't mended by, or merged with, the next one.
    """
    out: list[tuple[int, int, float]] = []
    run_ends = [i + 1 == len(at) or at[i + 1] != at[i] + 1 or of[i + 1] != of[i] + 1 for i in range(len(at))]
    total, most = len(times), sum(times.values())
    lo = hi = 0
    counts: dict[int, int] = {}
    while lo < len(at):
        while hi < len(at) and at[hi] - at[lo] < reach:
            counts[of[hi]] = counts.get(of[hi], 0) + 1
            hi += 1
        if len(counts) / total < threshold:
            counts[of[lo]] -= 1
            if not counts[of[lo]]:
                del counts[of[lo]]
            lo += 1
            continue
        best = None
        enough, start = lo, lo
        while start <= enough:
            seen: dict[int, int] = {}
            worth = 0
            for end in range(start, len(at)):
                if at[end] - at[start] >= reach:
                    break
                seen[of[end]] = seen.get(of[end], 0) + 1
                worth += 1 if seen[of[end]] <= times[of[end]] else -1
                if len(seen) / total < threshold:
                    continue
                if best is None:  # the shortest from the leftmost begin
                    enough = end
                    best = (-1, start, end, len(seen) / total)
                if run_ends[end] and worth > best[0]:
                    best = (worth, start, end, len(seen) / total)
            if best and best[0] == most:
                break
            start += 1
            while start <= enough and not run_ends[start - 1]:
                start += 1
        _, start, end, share = best
        out.append((at[start], at[end], share))
        lo = hi = end + 1
        counts = {}
    return out


class Index:
    """Band tables of all templates."""

    def __init__(self, templates: Mapping[str, str]):
        self.names, self.sets, self.places, self.times, self.lengths = [], [], [], [], []
        keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {size: [] for size, _ in SIZES}
        for name, text in sorted(templates.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            w = words(data, np.array([0, len(data)]), ALNUM)
            h, _ = ngram_hashes(w, SHINGLE)
            if not len(h):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            t, n = len(self.names), len(w.hash)
            self.names.append(name)
            own, place, count = np.unique(h, return_index=True, return_counts=True)
            self.sets.append(own)
            self.places.append(place)
            self.times.append(dict(zip(place.tolist(), count.tolist(), strict=True)))
            self.lengths.append(n)
            size = next(s for s, step in SIZES if n >= s + step - 1)
            own = self._keys(h, np.arange(n - size + 1), size)
            keys[size].append((own.ravel(), np.full(own.size, t)))
        self.tables = {}
        for size, step in SIZES:
            if keys[size]:
                key, of = (np.concatenate(x) for x in zip(*keys[size], strict=True))
                order = np.argsort(key, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[key & np.uint64(0xFFFFF)] = True
                self.tables[size, step] = key[order], of[order], seen

    @staticmethod
    def _keys(h: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
        if size == SHINGLE:
            return mix(h[begin])[:, None]
        return _band_keys(h, begin, begin + size - SHINGLE + 1)

    def retrieved(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, template, first shingle of the window) of all windows that meet a template."""
        found = []
        n = np.diff(first)
        for (size, step), (key, of, seen) in self.tables.items():
            width = size - SHINGLE + 1
            windows = np.where(n > 0, np.maximum(-(-(n - width) // step), 0) + 1, 0)
            text = np.repeat(np.arange(len(n)), windows)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = first[text] + nth * step
            for a in range(0, len(begin), 1 << 16):
                part = slice(a, a + (1 << 16))
                b, t = begin[part], text[part]
                if size == SHINGLE:
                    own = mix(h[b])[:, None]
                else:
                    base, top = int(b[0]), int(min(first[t[-1] + 1], b[-1] + width))
                    own = _band_keys(h[base:top], b - base, np.minimum(b + width, first[t + 1]) - base)
                row, band = np.nonzero(seen[own & np.uint64(0xFFFFF)])
                k = own[row, band]
                lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, "right")
                many = hi - lo
                row = np.repeat(row, many)
                which = of[np.arange(len(row)) + np.repeat(lo - (np.cumsum(many) - many), many)]
                found.append(np.stack([t[row], which, b[row]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def matches(self, h: np.ndarray, first: np.ndarray, threshold: float) -> list[list[tuple[str, int, int, float]]]:
        """For each text (template, first word, word after the last, containment), each place of a template once."""
        out: list[list] = [[] for _ in range(len(first) - 1)]
        met = self.retrieved(h, first)
        # windows of one text and template whose surroundings overlap are read as one stretch
        reach = np.array([n - SHINGLE + 1 + (n - SHINGLE + 1) // 4 for n in self.lengths], np.int64)[met[:, 1]]
        apart = np.ones(len(met), bool)
        apart[1:] = (met[1:, :2] != met[:-1, :2]).any(1) | (met[1:, 2] - reach[1:] > met[:-1, 2] + 2 * reach[:-1])
        firsts = np.flatnonzero(apart)
        lasts = np.append(firsts[1:], len(met)) - 1
        for i, j in zip(firsts.tolist(), lasts.tolist(), strict=False):
            text, t, at = met[i].tolist()
            own, width = self.sets[t], int(reach[i])
            a, b = int(max(first[text], at - width)), int(min(first[text + 1], met[j, 2] + 2 * width))
            near = h[a:b]
            spot = np.minimum(np.searchsorted(own, near), len(own) - 1)
            held = np.flatnonzero(own[spot] == near)
            base = a - int(first[text])
            for lo, hi, share in _places(held.tolist(), self.places[t][spot[held]].tolist(), self.times[t], width, threshold):
                out[text].append((self.names[t], base + lo, base + hi + SHINGLE, share))
        return [sorted(m, key=lambda x: (x[1], x[0])) for m in out]


_MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("containment", T.DoubleType())])
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))


def licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, threshold: float = 0.8, text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """Adds column licenses: array of (license, start_word, end_word, containment), in the order of the text.

    The templates, of a size that the caller knows, travel with the task; texts
    pass through once, whole, without a shuffle.  Words are runs of ASCII
    letters and digits and non-ASCII characters, A-Z lower-cased.  Null and
    empty texts have none.  Without templates of the caller's those of
    ``inventory`` are looked for, and SPDX lines.  A template is reported at each place where
    ``threshold`` or more of its distinct shingles stand within a stretch at
    most a quarter longer than itself; places of one template don't overlap.
    Columns in drop are left out.
    """
    chosen = dict(inventory() if templates is None else templates)
    ids = SPDX_IDS if templates is None else []

    def make():
        index, tags = Index(chosen), Tags(ids)

        def run(batch):
            out: list[Sequence] = []
            for _, _, data, offsets in blocks(column_of(batch, text)):
                w = words(data, offsets, ALNUM)
                found = index.matches(*ngram_hashes(w, SHINGLE), threshold)
                out += [sorted(m + t, key=lambda x: (x[1], x[0])) if t else m for m, t in zip(found, tags.matches(w), strict=True)]
            return [pa.array([[dict(zip(_MATCH.names, m, strict=True)) for m in ms] for ms in out], _ARROW)]

        return run

    return extended(docs, [T.StructField("licenses", T.ArrayType(_MATCH))], make, drop)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_matches, license_ids (sorted, comma-joined), spans (license:start:end, comma-joined)."""
    found = licenses(docs.select("doc_id", "text"), drop=["text"])
    spans = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start_word"].cast("string"), m["end_word"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("license_ids"), F.array_join(spans, ",").alias("spans"))
