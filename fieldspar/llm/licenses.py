"""License scans: normalised text against templates, by the Dice coefficient over word bigrams.

Texts are read as segments: sentences or lines, paragraphs, and the whole text.  A segment of a
bigrams and a template of b can reach a coefficient of t only if ``t / (2 - t) <= a / b <= (2 - t) / t``;
other templates are not compared.  The bound also says how many bigrams of templates a segment needs
at least; texts, and then segments, with fewer are left out before any template is looked up.  Case
and punctuation don't count.

Templates are short notices and the whole texts of short licences, a paragraph each and together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.llm import kernel
from fieldspar.llm.storage import small_batches

DICE = 0.8

# Licence notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Whole texts of short licences, by paragraph, without the copyright line.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
WHOLE: dict[str, tuple[str, ...]] = {
    "MIT": (TEMPLATES[18][1], "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS),
    "BSD-2-Clause": (_BSD, _BSD_1, _BSD_2, _BSD_END),
    "BSD-3-Clause": (_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_END),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
    ),
}
#: Paragraphs that one licence alone has are templates by themselves.
TEMPLATES += tuple((name, "\n\n".join(parts)) for name, parts in WHOLE.items())
TEMPLATES += tuple(
    (name, part) for name, parts in WHOLE.items() for part in parts if sum(part in own for own in WHOLE.values()) == 1 and all(part != body for _, body in TEMPLATES) and part != _AS_IS
)

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class _Matcher:
    """Sorted bigrams of all templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], dice: float) -> None:
        self.names, self.dice = [name for name, _ in templates], dice
        sets = []
        for _, text in templates:
            h, _ = kernel.words(pa.array([text]), kernel.LETTERS)
            sets.append(np.unique(_bigrams(h)))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], owner[order]
        ratio = dice / (2 - dice)
        self.low, self.high = np.ceil(self.sizes * ratio - 1e-9), np.floor(self.sizes / ratio + 1e-9)
        #: Template bigrams that any segment needs: t / 2 * (a + b) of them are shared, and a is not below the bound.
        self.least = int(np.ceil(dice / 2 * (self.low + self.sizes).min() - 1e-9)) if len(sets) else 0
        self.marks = np.zeros(1 << 16, bool)
        self.marks[self.grams & np.uint64(0xFFFF)] = True

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Where bigrams of templates are."""
        at = np.flatnonzero(self.marks[grams & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.grams, grams[at]), max(len(self.grams) - 1, 0))
        return at[self.grams[place] == grams[at]] if len(at) else at

    def best(self, grams: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, float]]:
        """(segment, template, coefficient): the best template of each segment that reaches the bound; the first of equal ones."""
        if not len(grams) or not len(self.grams):
            return []
        inside = (np.bincount(segment[self.known(grams)], minlength=int(segment.max()) + 1) >= self.least)[segment]
        if not inside.any():
            return []
        own = np.unique(np.stack([segment[inside].astype(np.uint64), grams[inside]]), axis=1)
        size = np.bincount(own[0].astype(np.int64), minlength=int(segment.max()) + 1)
        low, high = np.searchsorted(self.grams, own[1]), np.searchsorted(self.grams, own[1], side="right")
        at = np.repeat(np.arange(own.shape[1]), high - low)
        place = np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        seg, template = own[0][at].astype(np.int64), self.owner[place]
        fits = (size[seg] >= self.low[template]) & (size[seg] <= self.high[template])
        pairs, shared = np.unique(np.stack([seg[fits], template[fits]]), axis=1, return_counts=True)
        value = 2 * shared / (size[pairs[0]] + self.sizes[pairs[1]])
        out: dict[int, tuple[int, int, float]] = {}
        for s, t, v in zip(*pairs.tolist(), value.tolist(), strict=True):
            if v >= self.dice and v > out.get(s, (0, 0, 0.0))[2]:
                out[s] = (s, t, v)
        return list(out.values())


def _bigrams(h: np.ndarray) -> np.ndarray:
    return kernel.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)


def _scan(matcher: _Matcher) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, 1):
            h, counts = kernel.words(batch.column(1), kernel.LETTERS)
            ends = np.cumsum(counts)
            near = np.bincount(np.searchsorted(ends, matcher.known(_bigrams(h)), side="right"), minlength=len(counts)) if len(matcher.grams) else np.zeros(len(counts), np.int64)
            batch = batch.take(pa.array(np.flatnonzero(near >= max(matcher.least, 1))))
            if not batch.num_rows:
                continue
            data, _ = kernel.string_buffers(batch.column(1))
            h, counts, first, last = kernel.words(batch.column(1), kernel.LETTERS, places=True)
            row = np.repeat(np.arange(len(counts)), counts)
            rows: list[tuple[int, int, float]] = []
            if len(h) > 1:
                grams = _bigrams(h)
                gap = np.stack([last[:-1], first[1:]])
                breaks = lambda marks: (c := np.append(0, np.cumsum(marks)))[gap[1]] > c[gap[0]]
                blank = np.append(data[1:] <= 32, True)
                lines, stops = data == 10, _ENDS[data] & blank
                paragraphs = lines & np.append(data[1:] == 10, False)
                for marks in (lines | stops, paragraphs, np.zeros(len(data), bool)):
                    new = breaks(marks) | (row[1:] != row[:-1])
                    segment = np.cumsum(new)
                    keep = ~new
                    owner = np.zeros(int(segment[-1]) + 1, np.int64)
                    owner[segment] = row[1:]
                    rows += [(int(owner[s]), t, v) for s, t, v in matcher.best(grams[keep], segment[keep])]
            best: dict[tuple[int, str], float] = {}
            for r, t, v in rows:
                key = (r, matcher.names[t])
                best[key] = max(v, best.get(key, 0.0))
            found = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r for r, _ in found], pa.int64())), pa.array([n for _, n in found], pa.string()), pa.array([best[k] for k in found], pa.float64())], names=["id", "license", "dice"]
            )

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """(id, license, dice): licences whose notice a segment of the text reaches, with the best coefficient.

    Each segment counts for its best template only.  Documents are scanned once and never shuffled;
    the templates are a constant of a few kilobytes.

    Defined cases: ids are integers; null and empty texts and texts of one word match nothing; of equally good
    templates the first one counts; repeated rows give repeated results; a null id is carried; an
    empty table or no templates give an empty result; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = docs.mapInArrow(_scan(_Matcher(templates, dice)), "id long, license string, dice double")
    return rows.select(F.col("id").alias(id_col), "license", "dice")
