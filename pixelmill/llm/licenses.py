"""License scans: MinHash bands of overlapping windows retrieve templates, exact shingle containment verifies.

Templates of similar size form a class. Over a whole text, every shingle is hashed
once for each band; a class takes the least value of each window, half as long again
as its largest template. Windows start a third of their length apart, so that every
run of a template's length lies whole in one. A window shares a band with a template
where their least values are equal. A window that holds a share of 0.8 of a template
has a Jaccard similarity of at least 0.32 with it (0.8 / 2.45) and misses all
bands with a chance of (1 - 0.32)^64, 2e-11, at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import among, mix, shingle_hashes, utf8, word_hashes

#: Share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: MinHash bands of one row each: a pair of Jaccard similarity j is missed with a chance of (1 - j)^BANDS.
BANDS = 64
SHINGLE_WORDS = 5
#: The largest template of a class has at most this many times the shingles of the smallest, or three.
CLASS = 1.5
#: Shingles hashed at a time, of many texts or of one; pieces of a long text overlap by the longest window.
PIECE = 4096
#: Texts taken from a batch at a time.
TEXTS = 64

#: Names and notices as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
)


class Templates:
    """Templates by shingle length and class of sizes, with the least values of their bands."""

    def __init__(self, rows, bands: int = BANDS):
        self.seeds = (mix(np.arange(1, bands + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[:, None]
        made = []
        for name, text in rows:
            words = word_hashes(text.encode())
            if len(words):
                size = min(SHINGLE_WORDS, len(words))
                made.append((size, len(words) - size + 1, name, np.unique(shingle_hashes(words, size))))
        self.classes: list[tuple[int, int, np.ndarray, np.ndarray, list[dict[int, list[int]]], list[tuple[str, np.ndarray]]]] = []
        for size in sorted({m[0] for m in made}):
            left = sorted((m for m in made if m[0] == size), key=lambda m: m[1])
            while left:
                own = [m for m in left if m[1] <= max(3, CLASS * left[0][1])]
                left = left[len(own) :]
                index: list[dict[int, list[int]]] = [{} for _ in range(bands)]
                marks = np.zeros(1 << 16, dtype=bool)
                for i, (_, _, _, s) in enumerate(own):
                    for band, v in enumerate(self.hashes(s).min(1)):
                        index[band].setdefault(int(v), []).append(i)
                        marks[int(v) & 0xFFFF] = True
                values = np.unique(np.array([v for one in index for v in one], "<u4"))
                self.classes.append((size, max(1, own[-1][1] // 2), marks, values, index, [(m[2], m[3]) for m in own]))
        self.overlap = max((3 * c[1] for c in self.classes), default=0)

    def hashes(self, s: np.ndarray) -> np.ndarray:
        """32 bits of each shingle for each band: the shingle, which is mixed already, times an odd number of the band."""
        return ((s[None, :] * self.seeds) >> np.uint64(32)).astype(np.uint32)


def _found(parts: list[tuple[int, int, np.ndarray]], size: int, t: Templates, containment: float) -> Iterator[tuple[int, str, int, int]]:
    """(text, licence, first shingle, last shingle) of the windows that hold a template, over many parts of texts at once.

    A part is (text, place of its first shingle, shingles). All parts stand in one row.
    Least values of runs of 1, 2, 4, ... shingles serve the windows of all classes: a
    window is two such runs that overlap. A window that reaches beyond its part may meet
    a template there, which only adds candidates: containment is verified within the part.
    """
    s, counts = np.concatenate([p[2] for p in parts]), np.array([len(p[2]) for p in parts])
    ends = np.cumsum(counts)
    offsets = ends - counts
    runs = [np.full((len(t.seeds), len(s) + t.overlap), 0xFFFFFFFF, np.uint32)]
    runs[0][:, : len(s)] = t.hashes(s)
    for length, step, marks, values, index, own in t.classes:
        if length != size:
            continue
        wide = 3 * step
        level = wide.bit_length() - 1
        while len(runs) <= level:
            half = 1 << (len(runs) - 1)
            runs.append(np.minimum(runs[-1][:, :-half], runs[-1][:, half:]))
        rest = wide - (1 << level)
        if step == 1:
            starts = np.arange(len(s))
            least = np.minimum(runs[level][:, : len(s)], runs[level][:, rest : rest + len(s)])
        else:
            top = np.maximum(counts - wide, 0)
            windows = -(-top // step) + 1
            part = np.repeat(np.arange(len(parts)), windows)
            nth = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = offsets[part] + np.minimum(nth * step, top[part])
            least = np.minimum(runs[level].take(starts, 1), runs[level].take(starts + rest, 1))
        hits = np.flatnonzero(marks.take(least.astype(np.uint16)))  # the low 16 bits tell most values from the templates'
        hits = hits[among(least.ravel()[hits], values)]
        band, at = np.divmod(hits, len(starts))
        near = {(w, i) for b, w, v in zip(band.tolist(), starts[at].tolist(), least.ravel()[hits].tolist(), strict=True) for i in index[b].get(v, ())}
        for w, i in sorted(near):
            name, wanted = own[i]
            part = int(np.searchsorted(ends, w, "right"))
            window = s[w : min(w + wide, int(ends[part]))]
            held = np.flatnonzero(among(window, wanted))
            if len(np.unique(window[held])) >= containment * len(wanted):
                text, place, _ = parts[part]
                at = place + w - int(offsets[part])
                yield text, name, at + int(held[0]), at + int(held[-1])


def _pieces(words: list[np.ndarray], size: int, t: Templates) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Parts of texts, about PIECE shingles together; a long text is cut into parts that overlap by the longest window."""
    row, held = [], 0
    for i, w in enumerate(words):
        if len(w) < size:
            continue
        s = shingle_hashes(w, size)
        for start in range(0, len(s), PIECE):
            row.append((i, start, s[start : start + PIECE + t.overlap]))
            held += len(row[-1][2])
            if held >= PIECE:
                yield row
                row, held = [], 0
    if row:
        yield row


def licences(text: bytes, t: Templates, containment: float = CONTAINMENT) -> list[tuple[str, int, int]]:
    return all_licences([text], t, containment)[0]


def all_licences(texts: list[bytes], t: Templates, containment: float = CONTAINMENT) -> list[list[tuple[str, int, int]]]:
    """For each text (licence, first word, words) of all places that hold a template; those of one licence that overlap are one."""
    words = [word_hashes(x) for x in texts]
    found: list[dict[str, list[tuple[int, int]]]] = [{} for _ in texts]
    for size in sorted({c[0] for c in t.classes}):
        for row in _pieces(words, size, t):
            for i, name, first, last in _found(row, size, t, containment):
                found[i].setdefault(name, []).append((first, last + size))
    return [sorted(place for name, places in x.items() for place in _merged(name, places)) for x in found]


def _merged(name: str, places: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    (first, end), *others = sorted(places)
    for a, b in others:
        if a >= end:
            yield name, first, end - first
            first, end = a, b
        end = max(end, b)
    yield name, first, end - first


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, licenses (names in order, comma-joined), n_licenses, spans (name:first word:words) for each row.

    ``templates`` are rows of name and text, held by every worker: a bounded list, not a
    corpus. Null and empty texts have none; rows repeat as they come; extra columns are
    ignored; templates of fewer than five words are one shingle of their length, those
    without words are left out.
    """
    t = Templates(templates)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for at in range(0, b.num_rows, TEXTS) for x in all_licences(b.column(1).slice(at, TEXTS).to_pylist(), t, containment)]
            each = [sorted({g[0] for g in x}) for x in got]
            spans = pa.array([",".join(f"{g[0]}:{g[1]}:{g[2]}" for g in x) for x in got], pa.string())
            columns = [b.column(0), pa.array([",".join(x) for x in each], pa.string()), pa.array([len(x) for x in each], pa.int64()), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licenses", "n_licenses", "spans"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, f"doc_id {kind}, licenses string, n_licenses long, spans string")
