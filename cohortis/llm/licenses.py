"""License scans: MinHash bands over overlapping text windows retrieve templates; shingle containment verifies them.

Words are runs of 0-9, a-z and non-ASCII bytes after A-Z are lower-cased; shingles are five words. Windows of 2s
shingles begin every s shingles, for s = 2, 8, 32, ... as far as the templates need, so a template of up to s + 1
shingles lies whole in a window of the smallest s that is enough, and shares at least an eighth of that window's shingles. With BANDS bands of one minimum
each, a window that holds the whole template is retrieved with a probability of 1 - (1 - 1/8)**48 = 0.998 or more, and
one that holds only the required four fifths of it with 0.99 or more. Which templates match is then decided exactly:
the share of a template's different shingles in the best span of 2s shingles about the window, compared word by word. A span
ends with the last shingle that adds to its share, so where it ends doesn't depend on the windows.
A template of fewer than five words is one shingle of its own length, found wherever these words follow one another.
Very long texts are taken in pieces that overlap by more than the longest span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 48
#: Shingles between the closest windows; each further stride is four times the one before.
STRIDE, STEP = 2, 4
#: Bytes of a text that are taken at once.
PIECE = 1 << 20

# Notices as licenses ask for them or as they are commonly given, and whole texts of short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
MATCH = "array<struct<template: string, containment: double, begin: int, end: int>>"


class Templates:
    """Shingles of every template, and by stride the minima that retrieve it."""

    def __init__(self, texts: dict[str, str], bands: int = BANDS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.shingles, self.words = [], [], []
        by_stride: dict[int, list[int]] = {}
        #: Number of words -> the hashes of templates that are so short, and the templates.
        self.short: dict[int, tuple[list, list]] = {}
        table = common.word_table()
        for name, text in texts.items():
            words = common.Words([text.encode()], table)
            n = len(words.code)
            if not n:
                raise ValueError(f"{name}: a template has words")
            size = min(SHINGLE, n)
            code = np.unique(words.windows(size)[1])
            if n < SHINGLE:
                hashes, templates = self.short.setdefault(n, ([], []))
                hashes.append(code[0])
                templates.append(len(self.names))
            else:
                stride = STRIDE
                while n - SHINGLE > stride:
                    stride *= STEP
                by_stride.setdefault(stride, []).append(len(self.names))
            self.names.append(name)
            self.shingles.append(code)
            each = [words.word(i) for i in range(n)]
            self.words.append({b" ".join(each[i : i + size]) for i in range(n - size + 1)})
        self.strides = [STRIDE]
        while self.strides[-1] < max(by_stride, default=0):
            self.strides.append(self.strides[-1] * STEP)
        #: stride -> for each band: a bitmap of the minima's low 16 bits, the sorted minima, and their templates.
        self.bands = {s: [self._band(f, ts) for f in self.factors] for s, ts in by_stride.items()}

    def _band(self, factor, templates: list[int]):
        least = np.array([((self.shingles[t] * factor) >> np.uint64(32)).min() for t in templates], dtype=np.uint32)
        order = np.argsort(least, kind="stable")
        bits = np.zeros(1 << 16, dtype=bool)
        bits[least & 0xFFFF] = True
        return bits, least[order], np.array(templates)[order]

    def candidates(self, code: np.ndarray) -> set[tuple[int, int, int]]:
        """(stride, window, template) that share a band; windows are numbered along the shingles given."""
        found: set[tuple[int, int, int]] = set()
        if not len(code):
            return found
        top = self.strides[-1]
        whole = -(-len(code) // top) * top if self.bands else 0
        for band, factor in enumerate(self.factors if self.bands else []):
            least = np.full(whole, 0xFFFFFFFF, dtype=np.uint32)
            least[: len(code)] = (code * factor) >> np.uint64(32)
            for s in self.strides:
                least = least.reshape(-1, STRIDE if s == STRIDE else STEP).min(axis=1)
                if s not in self.bands:
                    continue
                window = np.minimum(least, np.concatenate([least[1:], least[-1:]]))
                bits, minima, templates = self.bands[s][band]
                maybe = np.flatnonzero(bits[window & 0xFFFF])
                left, right = np.searchsorted(minima, window[maybe]), np.searchsorted(minima, window[maybe], side="right")
                for i in np.flatnonzero(left < right).tolist():
                    found.update((s, int(maybe[i]), int(t)) for t in templates[left[i] : right[i]])
        return found

    def matches(self, texts: list[bytes], least: float = CONTAINMENT, goes_on: bool = False) -> list[list[dict]]:
        """For each text its templates, by name: the best containment, and where in the text (in UTF-8 bytes) it begins and ends.
        goes_on: the only text is a piece, whose last spans are left to the next."""
        words = common.Words(texts, common.word_table())
        at, code = words.windows(SHINGLE)
        best: list[dict] = [{} for _ in texts]
        offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for s, window, t in sorted(self.candidates(code)):
            # The best span needn't be aligned as windows are: any of 2s shingles that meets the window.
            place = np.arange(max(0, (window - 2) * s), min(len(code), (window + 4) * s))
            place = place[np.isin(code[place], self.shingles[t])]
            for doc in np.unique(words.doc[at[place]]).tolist():
                own = [p for p in place.tolist() if words.doc[at[p]] == doc]
                same = {p: b" ".join(words.word(j) for j in range(at[p], at[p] + SHINGLE)) for p in own}
                own = [p for p in own if same[p] in self.words[t]]
                for i, p in enumerate(own):
                    if goes_on and p + 2 * s > len(code):
                        break
                    met, last = set(), p
                    for q in own[i:]:
                        if q < p + 2 * s and same[q] not in met:
                            met.add(same[q])
                            last = q
                    share = len(met) / len(self.words[t])
                    if share >= least:
                        begin, end = int(words.start[at[p]] - offset[doc]), int(words.end[at[last] + SHINGLE - 1] - offset[doc])
                        key, name = (-share, begin, end), self.names[t]
                        best[doc][name] = min(best[doc].get(name, key), key)
        for size, (hashes, templates) in self.short.items():
            at, code = words.windows(size)
            for i in np.flatnonzero(np.isin(code, np.array(hashes, dtype=np.uint64))).tolist():
                p, text = int(at[i]), b" ".join(words.word(j) for j in range(at[i], at[i] + size))
                doc = int(words.doc[p])
                key = (-1.0, int(words.start[p] - offset[doc]), int(words.end[p + size - 1] - offset[doc]))
                for t in (t for t, h in zip(templates, hashes, strict=True) if h == code[i] and text in self.words[t]):
                    best[doc][self.names[t]] = min(best[doc].get(self.names[t], key), key)
        return [[{"template": n, "containment": -k[0], "begin": k[1], "end": k[2]} for n, k in sorted(x.items())] for x in best]

    def in_long(self, text: bytes, least: float) -> tuple[int, list[dict]]:
        """The number of words and matches() of one text, piece by piece."""
        n, best, table = 0, {}, common.word_table()
        for a, b, shared in common.pieces(text, table, 2 * self.strides[-1] + SHINGLE, PIECE):
            n += len(common.Words([text[a:b]], table).start) - shared
            for m in self.matches([text[a:b]], least, goes_on=b < len(text))[0]:
                key = (-m["containment"], m["begin"] + a, m["end"] + a)
                best[m["template"]] = min(best.get(m["template"], key), key)
        return n, [{"template": t, "containment": -k[0], "begin": k[1], "end": k[2]} for t, k in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches (MATCH, by name) of every whole text.

    Each template is listed once, at the first of its best places. A null or empty text matches nothing; repeated rows are each scanned; an empty table gives an empty result; other columns are
    ignored. No shuffle; the templates, a stated list, are the only thing broadcast.
    """
    spark = docs.sparkSession
    common.ship(spark)
    told = spark.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.word_table()
        for batch in batches:
            texts = common.text_bytes(batch.column(1))
            for begin, end in common.slices(texts, PIECE):
                part = texts[begin:end]
                if len(part[0]) > PIECE:
                    n, found = ([x] for x in told.value.in_long(part[0], least))
                else:
                    n, found = np.diff(common.Words(part, table).first), told.value.matches(part, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, matches {MATCH}")
