"""License scan: shared runs of words pick candidates, banded alignment measures them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lineout.llm.common import map_arrow
from lineout.llm.words import ALNUM, Words, blocks, shingles, text_bytes, words

# Published license notices and grants: fixed values, any mapping can be passed instead.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
    "BSD": "Released under the BSD License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED."
    ),
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial"}
_CC |= {f"BY-NC-{k[3:]}": v.replace("Attribution", "Attribution-NonCommercial") for k, v in _CC.items() if k in ("BY-SA", "BY-ND")}
for _code, _name in _CC.items():
    TEMPLATES[f"CC-{_code}-4.0-notice"] = f"Licensed under CC {_code} 4.0."
    TEMPLATES[f"CC-{_code}-4.0"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
GRAM = 3  # shared words in a row that make a candidate
LEAST = 4  # words of a longer template that a place matches at least
BAND = 8  # words inserted or left out that the alignment follows
COVERAGE = 0.6
BITMAP = 16

FOUND = "doc_id long, license string, coverage double, matched_words int, start_char int, end_char int"


def grams(found: Words, size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of ``size`` words: hash, row and place (word index within the row). A shorter row is one run."""
    hashes, row = shingles(found, size)
    return hashes, row, np.arange(len(row)) - np.searchsorted(row, row)


class _Index:
    """Inverted index of the templates' runs of words, small by the templates given."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        found = words(pa.array(list(templates.values()), pa.string()), inside_of=ALNUM)
        self.words = [found.hashes[a:b] for a, b in zip(found.first, found.first[1:])]
        self.sizes = {GRAM} | {len(w) for w in self.words if 0 < len(w) < GRAM}  # a shorter template is one run of its own size
        hashes, template, place = grams(found)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.template, self.place = hashes[order], template[order], place[order]
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - BITMAP)).astype(np.int64)] = True

    def hits(self, found: Words) -> np.ndarray:
        """Rows of (row, template, place in the text, place in the template), sorted."""
        out = np.concatenate([self._hits(*grams(found, size)) for size in self.sizes])
        return np.unique(out, axis=0)  # a short row is the same run at several sizes

    def _hits(self, hashes: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - BITMAP)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[maybe], side="left")
        high = np.searchsorted(self.hashes, hashes[maybe], side="right")
        at, many = np.repeat(maybe, high - low), high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else low
        return np.stack([row[at], self.template[entry], place[at], self.place[entry]], axis=1)


def aligned(text: np.ndarray, template: np.ndarray, shift: int) -> list[int]:
    """Places in ``text`` of the words matched by the longest common subsequence near diagonal ``shift``.

    Word i of the template may meet places i + shift - BAND .. i + shift + BAND.
    """
    width = 2 * BAND + 1
    best = np.zeros((len(template) + 1, width + 1), np.int32)  # the last column lies outside the band
    places = np.arange(width) + shift - BAND
    for i, word in enumerate(template):
        at = places + i
        inside = (at >= 0) & (at < len(text))
        equal = np.zeros(width, bool)
        equal[inside] = text[at[inside]] == word
        best[i + 1, :width] = np.maximum.accumulate(np.maximum(best[i, :width] + equal, best[i, 1:]))
    matched, i, b = [], len(template), width - 1
    while i > 0 and best[i, b] > 0:
        at = i - 1 + shift - BAND + b
        if b > 0 and best[i, b - 1] == best[i, b]:
            b -= 1
        elif best[i - 1, b + 1] == best[i, b] and b + 1 < width:
            i, b = i - 1, b + 1
        elif 0 <= at < len(text) and text[at] == template[i - 1]:
            matched.append(at)
            i -= 1
        else:
            i, b = i - 1, min(b + 1, width - 1)
    return matched[::-1]


def _regions(hits: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(row, template, diagonal) for each cluster of hits that one copy of the template can explain."""
    begin = 0
    for k in range(1, len(hits) + 1):
        if k < len(hits) and (hits[k, :2] == hits[begin, :2]).all() and hits[k, 2] - hits[begin, 2] < sizes[hits[begin, 1]] + BAND and hits[k, 3] > hits[k - 1, 3]:
            continue
        cluster = hits[begin:k]
        yield int(cluster[0, 0]), int(cluster[0, 1]), int(np.median(cluster[:, 2] - cluster[:, 3]))
        begin = k


def _best(places: list[tuple[int, np.ndarray]], sizes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Places but those with words left out or between, all of whose words another template explains better.

    "CC BY-NC 4.0" is no place of "CC BY 4.0", nor the reverse. A whole copy always stays.
    """
    places = sorted(places, key=lambda p: p[1][0])
    begins, widest = [at[0] for _, at in places], max(at[-1] - at[0] for _, at in places)
    for template, at in places:
        share = len(at) / len(sizes[template])
        whole = share == 1 and at[-1] - at[0] == len(at) - 1
        around = places[bisect_left(begins, at[0] - widest) : bisect_right(begins, at[0])]
        if whole or not any((len(by), len(by) / len(sizes[other])) > (len(at), share) and at[-1] <= by[-1] and np.isin(at, by).all() for other, by in around):
            yield template, at


def _scanner(templates: Mapping[str, str], coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates)
        for batch in blocks(batches):
            found = words(batch.column("text"), inside_of=ALNUM)
            rows, free, places = [], {}, {}
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for row, template, shift in _regions(index.hits(found), [len(w) for w in index.words]):
                wanted, skip = index.words[template], free.get((row, template), 0)
                a = found.first[row] + skip  # words of an earlier place are used up
                least = max(coverage * len(wanted), min(LEAST, len(wanted)))
                text = found.hashes[a : found.first[row + 1]]
                near = text[max(0, shift - skip - BAND) : max(0, shift - skip + len(wanted) + BAND)]
                if np.isin(wanted, near).sum() < least:  # no alignment matches more
                    continue
                matched = aligned(text, wanted, shift - skip)
                if len(matched) < least:
                    continue
                free[row, template] = skip + matched[-1] + 1
                places.setdefault(row, []).append((template, a + np.array(matched)))
            for row, (template, at) in ((row, place) for row, of in places.items() for place in _best(of, index.words)):
                start, end = found.starts[at[0]], found.ends[at[-1]]
                letters = (data[offsets[row] : end] & 0xC0) != 0x80
                before = int(letters[: start - offsets[row]].sum())
                rows.append((ids[row], index.names[template], len(at) / len(index.words[template]), len(at), before, int(letters.sum())))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            names = [field.split()[0] for field in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return scan


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per place where a template is found: doc_id, license, coverage, matched words and character span.

    Words are runs of letters and digits, A-Z lower-cased. Every place that shares
    ``GRAM`` words in a row with a template, or all words of a shorter one, is a candidate, over the
    whole text; it counts if the alignment matches at least ``coverage`` of the
    template's words, and ``LEAST`` of them or all. The span is in code points, from the first to the last
    matched word. One text may match several templates and a template several
    times; a place with words left out or between is not returned if another template
    matches all its words and more. Null and empty texts match nothing; a null id is returned as null.
    Documents are scanned one by one where they lie: nothing is shuffled.
    """
    return map_arrow(docs.select("doc_id", "text"), _scanner(dict(templates), coverage), FOUND)


def op5_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
