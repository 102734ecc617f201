"""Operator 8: license scan by MinHash bands over overlapping text windows.

Text and templates are cut into lower-case words (letters, digits and other
characters beyond ASCII; typographic punctuation and no-break spaces separate
words like their plain forms), and these into 5-word shingles.  A template of n shingles belongs to the
class c, the next power of two.  For each class the text is covered by
windows of c + c/4 shingles, c/4 apart, so every run of c shingles lies in
one of them (for c up to 4: windows of c, one apart).  A window that holds
``CONTAINMENT`` of a template's shingles is at least ``least_similarity(c)``
similar to it; with bands of one row, ``bands_of(c)`` of them miss such a
window with a chance below ``MISS``.  The band values of a class's templates form
one index: a table of marks sorts out nearly all windows at once, the rest
look up their templates, so the cost of a window doesn't depend on how many
templates there are.  Every retrieved window is verified by the exact share
of the template's shingles it holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import NOT_ALNUM, U64, located_words, shingle_hashes, slices, text_bytes

CONTAINMENT = 0.8
MISS = 1e-4
SEGMENT = 16_384                 # shingles hashed at once in a long text
CELLS = 64                       # cells of marks to a template, at least
FOUND = "doc_id long, license string, template string, containment double, start long, end long, occurrences int"

# fixed values: public notices and the opening terms of common licenses (five words or more)
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "released", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("MIT", "terms", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""),
    ("MIT", "warranty", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", """you may not use this file except in compliance with the License. You may obtain a copy of the License
at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "notice", "This work is licensed under the GNU General Public License, version 2 or later."),
    ("GPL-3.0-or-later", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-3.0-or-later", "header", """This library is free software: you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
    ("AGPL-3.0-or-later", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
    ("EPL-2.0", "header", """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("BSL-1.0", "notice", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "terms", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1.
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution."""),
    ("BSD-3-Clause", "endorsement", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", "terms", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("ISC", "terms", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "short", "Licensed under CC BY 4.0 terms."),
    ("CC-BY-NC-4.0", "short", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "terms", "This is free and unencumbered software released into the public domain."),
)


def window_of(c: int) -> tuple[int, int]:
    """Window length and step, in shingles, of class c."""
    return (c, 1) if c <= 4 else (c + c // 4, c // 4)


def least_similarity(c: int) -> float:
    """Least Jaccard similarity of a class-c template to a window that holds
    CONTAINMENT of it (the smallest template of the class is the worst)."""
    n = c // 2 + 1 if c > 1 else 1
    return CONTAINMENT * n / (window_of(c)[0] + (1 - CONTAINMENT) * n)


def bands_of(c: int) -> int:
    return math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - least_similarity(c)))) if c > 1 else 1


@dataclass
class BandIndex:
    """Band values of a class's templates: (band, value) -> templates."""
    marks: np.ndarray            # bands x cells: a template has a value in the cell
    shift: int                   # value >> shift is its cell
    templates: dict[tuple[int, int], list[int]]

    def retrieve(self, low: np.ndarray) -> dict[int, list[int]]:
        """window -> templates it shares a band with, for ``low`` (windows x bands)."""
        found: dict[int, list[int]] = {}
        cells = (low >> np.uint32(self.shift)).astype(np.intp) + np.arange(low.shape[1]) * self.marks.shape[1]
        at = np.flatnonzero(self.marks.ravel()[cells])
        for w, band in zip((at // low.shape[1]).tolist(), (at % low.shape[1]).tolist(), strict=True):
            for t in self.templates.get((band, int(low[w, band])), ()):
                if t not in found.setdefault(w, []):
                    found[w].append(t)
        return found


def band_index(lows: np.ndarray, members: list[int], bands: int) -> BandIndex:
    """At least CELLS cells to a template, so few windows of other texts meet a mark."""
    bits = max(12, (CELLS * len(members) - 1).bit_length())
    marks = np.zeros((bands, 1 << bits), bool)
    templates: dict[tuple[int, int], list[int]] = {}
    for t in members:
        for band, value in enumerate(lows[t, :bands].tolist()):
            marks[band, value >> (32 - bits)] = True
            templates.setdefault((band, value), []).append(t)
    return BandIndex(marks, 32 - bits, templates)


@dataclass
class Index:
    names: list[tuple[str, str]]
    sets: list[np.ndarray]
    classes: dict[int, BandIndex]
    mult: np.ndarray
    flip: np.ndarray


def plain(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with spaces for the bytes of no-break spaces, typographic
    quotes, dashes, dots and spaces, and guillemets; the length is the same."""
    lead = np.flatnonzero(raw[:-1] == 0xC2)
    two = lead[np.isin(raw[lead + 1], (0xA0, 0xAB, 0xBB))]                     # U+00A0, U+00AB, U+00BB
    lead = np.flatnonzero(raw[:-2] == 0xE2)
    lead = lead[raw[lead + 1] == 0x80]
    last = raw[lead + 2]
    three = lead[((last >= 0x80) & (last <= 0x8A)) | ((last >= 0x90) & (last <= 0xAF)) | (last == 0xB9) | (last == 0xBA)]   # U+2000-200A, 2010-202F, 2039, 203A
    if not len(two) and not len(three):
        return raw
    out = raw.copy()
    for start, width in ((two, 2), (three, 3)):
        for k in range(width):
            out[start + k] = 0x20
    return out


def _shingles(text: str) -> np.ndarray:
    raw, offsets = text_bytes(pa.array([text]))
    words, at, _ = located_words(plain(raw), offsets, NOT_ALNUM)
    return shingle_hashes(words, 0, int(at[-1])) if int(at[-1]) >= 5 else np.zeros(0, U64)


def build(templates=TEMPLATES, seed: int = 8) -> Index:
    """Bands and shingle sets of the templates; one of fewer than five words
    has no shingle and raises."""
    sets: list[np.ndarray] = []
    classes: dict[int, list[int]] = {}
    for k, (license_id, name, text) in enumerate(templates):
        s = np.unique(_shingles(text))
        if not len(s):
            raise ValueError(f"template {license_id}/{name} has fewer than five words")
        sets.append(s)
        classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
    bands = max((bands_of(c) for c in classes), default=1)
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 2**31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 2**32, bands, dtype=np.uint32)
    lows = np.array([_hashed(s, mult, flip).min(axis=0) for s in sets], dtype=np.uint32).reshape(-1, bands)
    indexes = {c: band_index(lows, members, bands_of(c)) for c, members in classes.items()}
    return Index([(a, b) for a, b, _ in templates], sets, indexes, mult, flip)


def _hashed(shingles: np.ndarray, mult: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Band values (shingles x bands) from the hashes' upper halves."""
    return ((shingles >> U64(32)).astype(np.uint32)[:, None] ^ flip) * mult


def _halved(blocks: np.ndarray) -> np.ndarray:
    """Minima of neighbouring blocks, two by two."""
    if len(blocks) % 2:
        blocks = np.concatenate([blocks, blocks[-1:]])
    return np.minimum(blocks[::2], blocks[1::2])


def _windows(index: Index, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(template, lo, hi): windows that share a band with the template."""
    blocks, size = _hashed(shingles, index.mult, index.flip), 1
    for c, retrieved in sorted(index.classes.items()):
        (length, step), bands = window_of(c), bands_of(c)
        while size < step:
            blocks, size = _halved(blocks), 2 * size
        span = length // step
        count = max(1, len(blocks) - span + 1)
        low = blocks[:count, :bands]
        for k in range(1, min(span, len(blocks))):
            low = np.minimum(low, blocks[k:k + count, :bands])
        for w, templates in sorted(retrieved.retrieve(low).items()):
            for t in templates:
                yield t, w * step, min(len(shingles), w * step + length)


def scan(index: Index, shingles: np.ndarray) -> dict[int, tuple[float, list[tuple[int, int]]]]:
    """template -> (best containment, separate occurrences as shingle ranges)."""
    found: dict[int, tuple[float, list[tuple[int, int]]]] = {}
    overlap = max((window_of(c)[0] for c in index.classes), default=0)
    for base in range(0, max(1, len(shingles)), SEGMENT):
        part = shingles[base:base + SEGMENT + overlap]
        for t, lo, hi in _windows(index, part) if len(part) else ():
            held = np.isin(part[lo:hi], index.sets[t])
            share = len(np.unique(part[lo:hi][held])) / len(index.sets[t])
            if share < CONTAINMENT:
                continue
            at = np.flatnonzero(held)
            span = (base + lo + int(at[0]), base + lo + int(at[-1]) + 1)
            best, spans = found.get(t, (0.0, []))
            if spans and span[0] < spans[-1][1]:
                spans[-1] = (min(span[0], spans[-1][0]), max(span[1], spans[-1][1]))
            else:
                spans.append(span)
            found[t] = (max(best, share), spans)
    return found


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            raw, offsets = text_bytes(batch.column("text"))
            words_of = plain(raw)
            for lo, hi in slices(offsets):
                words, at, first = located_words(words_of, offsets[lo:hi + 1], NOT_ALNUM)
                for i in range(hi - lo):
                    a, b = int(at[i]), int(at[i + 1])
                    if b - a < 5:
                        continue
                    begin = int(offsets[lo + i])
                    chars = lambda byte, begin=begin: len(raw[begin:byte].tobytes().decode("utf-8", "replace"))
                    for t, (share, spans) in sorted(scan(index, shingle_hashes(words, a, b)).items()):
                        s, e = spans[0]
                        start = int(offsets[lo]) + int(first[a + s])
                        last = int(offsets[lo]) + int(first[a + e + 3])          # the last word's first byte
                        stop = last
                        while stop < int(offsets[lo + i + 1]) and not NOT_ALNUM[words_of[stop]]:
                            stop += 1
                        out.append((ids[lo + i], *index.names[t], share, chars(start), chars(stop), len(spans)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                             names=["doc_id", "license", "template", "containment", "start", "end", "occurrences"])
    return run


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Licenses found in the whole texts of ``docs`` (doc_id, text, ...).

    One row per document and template: license, template, containment (best
    share of the template's shingles in one window), start and end (code
    points of the first occurrence), occurrences (separate ones).  A null or
    short text (fewer than five words) has none; repeated rows give repeated
    results; a document may hold several licenses.  The work is map-only.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(build(templates)), FOUND)
