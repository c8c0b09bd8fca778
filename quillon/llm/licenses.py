"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line, in overlapping pieces of PIECE words (in long lines also of SHORT words). Hashed single words
and word pairs feed a multinomial logistic regression over the licence families and `unknown`. It is trained on the
driver on notices and paragraphs of licences (KNOWN) that are cut, joined, disturbed and put into long lines, and, as
`unknown`, on made-up prose, prose about licences, and a bounded sample of the corpus (PIECES pieces of SAMPLE
documents). A held-out part sets the temperature at which the class probabilities are calibrated. Neighbouring and
overlapping pieces of one family are one finding; it is confirmed if it shares enough word triples with one of the
family's templates, or the template with it.

A null or empty text has no paragraphs and no finding. Rows stay apart whatever their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import parts
from .textvec import LOWER, Texts, mixed

#: Words of a piece; documents sampled for `unknown`, and pieces of theirs; least probability of a family; least share of common triples.
PIECE, SAMPLE, PIECES, LEAST, ALIKE = 40, 400, 4000, 0.5, 0.6
#: Words of the smaller pieces of a line, for short notices in its midst.
SHORT = 12
BITS = 15
UNKNOWN = "unknown"

# The wording of public licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Published under CC0 1.0 Universal public domain dedication.",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
# Paragraphs of public licences.
BODIES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files.",
    ),
    "GPL": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",),
    "BSD": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
        "SPDX-License-Identifier: EPL-2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ),
}
KNOWN: dict[str, tuple[str, ...]] = {f: TEMPLATES.get(f, ()) + BODIES.get(f, ()) for f in [*TEMPLATES, *(f for f in BODIES if f not in TEMPLATES)]}
# Prose that has the words but is no notice.
NEAR = (
    "he lost his driving license on the way to the station and had to apply for a new one",
    "the general public was invited to the opening of the new library last week",
    "the committee discussed which license the software should have before its release",
    "a version of the story was released in the spring and the public liked it",
    "the apache helicopter landed near the school while the students of mit watched",
    "you may obtain a copy of the form at the office during working hours",
    "permission was granted to the family to build a house in the village",
    "she kept the rights to her work and reserved a table for the evening",
)

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if b != 10 and not chr(b).isalnum()]] = 32


class Folded(Texts):
    """Words of letters and digits, in lower case."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, fold=_FOLD)


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # (2 << BITS) x families
    bias: np.ndarray
    temperature: float = 1.0
    triples: dict[str, list[frozenset]] = field(default_factory=dict)

    def probabilities(self, t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each piece: words start to end."""
        logits = self.bias[None].repeat(len(start), axis=0)
        for bucket, less in _buckets(t):
            w = self.weights[bucket]
            sums = np.zeros((len(w) + 1, w.shape[1]))
            np.cumsum(w, axis=0, out=sums[1:])
            stop = np.minimum(np.maximum(end - less, start), len(w))
            logits += (sums[stop] - sums[np.minimum(start, len(w))]) / np.maximum(stop - np.minimum(start, len(w)), 1)[:, None]
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _buckets(t: Texts):
    h = t.word_hash()
    yield (h >> np.uint64(64 - BITS)).astype(np.int32), 0
    yield (mixed(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]) >> np.uint64(64 - BITS)).astype(np.int32) + (1 << BITS), 1


def pieces(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, first word and end of each piece."""
    feeds = np.concatenate([[0], np.cumsum(t.data == 10)])
    text = np.repeat(np.arange(t.n), t.n_words)
    line = feeds[t.start]
    new = np.ones(len(t.start), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    place = np.arange(len(new)) - first[line]
    size = np.diff(np.append(first, len(new)))[line]
    found = []
    for width in (PIECE, SHORT):
        # half overlapping, until one reaches the line's end
        start = np.flatnonzero((place % (width // 2) == 0) & ((place == 0) | (place + width - width // 2 < size)))
        if width == SHORT:
            start = start[size[start] > PIECE]
        found.append((text[start], start, start + np.minimum(width, size[start] - place[start])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def triples(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else frozenset([tuple(words)])


def _words(text: str) -> list[bytes]:
    return bytes(_FOLD[np.frombuffer(text.encode(), np.uint8)]).split()


def likeness(words: list[bytes], templates: list[frozenset]) -> float:
    """The largest share of common triples, of the words' or of a template's, whichever has fewer."""
    own = triples(words)
    return max(len(own & t) / min(len(own), len(t)) for t in templates)


def training_rows(sample: list[str], seed: int = 3, copies: int = 60) -> tuple[list[str], list[str]]:
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    prose = [w for text in sample[:50] for w in text.split()[:2000]]
    letters = list("etaoinshrdluüéç")
    noise = lambda n: " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n))
    for family, notices in KNOWN.items():
        for notice in notices:
            words = notice.split()
            for i in range(copies):
                own = list(words)
                if i and len(own) > 14:  # a part, as a line break or a piece makes it
                    n = int(rng.integers(10, min(len(own), PIECE) + 1))
                    at = int(rng.integers(0, len(own) - n + 1))
                    own = own[at : at + n]
                if i > 2 and len(own) > 6:
                    own = [w for w in own if rng.random() > 0.06]
                if i % 3 == 1:
                    own = [*noise(rng.integers(1, 4)).split(), *own]
                if i % 4 == 2:
                    own = [*own, *noise(rng.integers(1, 4)).split()]
                width = PIECE if i % 10 == 4 else SHORT
                if i % 5 == 4 and len(own) < width:  # a piece of a long line
                    at = int(rng.integers(0, max(1, len(prose) - width)))
                    around = prose[at : at + width - len(own)] if prose and i % 4 else noise(width - len(own)).split()
                    cut = int(rng.integers(0, len(around) + 1))
                    own = [*around[:cut], *own, *around[cut:]]
                texts.append(" ".join(own))
                labels.append(family)
    known = [triples(_words(n)) for notices in KNOWN.values() for n in notices]
    for text in [*NEAR * 30, *(noise(rng.integers(1, PIECE)) for _ in range(1500))]:
        texts.append(text)
        labels.append(UNKNOWN)
    some = [" ".join(words[i : i + PIECE]) for text in sample for words in map(str.split, text.split("\n")) for i in range(0, len(words), PIECE)]
    if len(some) > PIECES:
        some = [some[i] for i in np.sort(rng.choice(len(some), PIECES, replace=False))]
    for piece in some:
        folded = _words(piece)
        if folded and likeness(folded, known) < 0.3:
            texts.append(piece)
            labels.append(UNKNOWN)
    return texts, labels


def fit(sample: list[str], steps: int = 150, rate: float = 1.0, decay: float = 3e-7) -> Model:
    """Trained on four fifths of the rows; the others calibrate the temperature."""
    texts, labels = training_rows(sample)
    families = [*KNOWN, UNKNOWN]
    y = np.array([families.index(f) for f in labels])
    t = Folded(pa.array(texts))
    rows, cols, vals = [], [], []
    for bucket, less in _buckets(t):
        row = np.repeat(np.arange(t.n), t.n_words)
        whole = row[: len(bucket)] == row[less:][: len(bucket)]
        rows.append(row[: len(bucket)][whole])
        cols.append(bucket[whole])
        vals.append(1 / np.maximum(t.n_words - less, 1)[rows[-1]])
    row, col, val = map(np.concatenate, (rows, cols, vals))
    used, col = np.unique(col, return_inverse=True)
    order = np.argsort(row, kind="stable")
    row, col, val = row[order], col[order], val[order]
    begin = np.searchsorted(row, np.arange(t.n))
    filled = begin < np.append(begin[1:], len(row))
    by_col = np.argsort(col, kind="stable")
    col_begin = np.searchsorted(col[by_col], np.arange(len(used)))
    apart = np.arange(t.n) % 5 == 4
    n = np.bincount(y[~apart], minlength=len(families))
    weight = np.where(apart, 0, 1 / (len(families) * np.maximum(n, 1))[y])
    target = np.eye(len(families))[y]
    w, b = np.zeros((len(used), len(families))), np.zeros(len(families))
    by, by_bias = features.Adam(w.shape, rate), features.Adam(b.shape, rate / 10)

    def logits():
        out = np.tile(b, (t.n, 1))
        out[filled] += np.add.reduceat(val[:, None] * w[col], begin[filled], axis=0)
        return out

    for _ in range(steps):
        wrong = weight[:, None] * (softmax(logits()) - target)
        w -= by.step(np.add.reduceat((val[:, None] * wrong[row])[by_col], col_begin, axis=0) + decay * w)
        b -= by_bias.step(wrong.sum(axis=0))
    scored = logits()[apart]
    cost = lambda temp: -np.log(softmax(scored / temp)[np.arange(len(scored)), y[apart]] + 1e-12).mean()
    temperature = min(np.geomspace(0.5, 8, 25), key=cost)
    weights = np.zeros((2 << BITS, len(families)), np.float32)
    weights[used] = w
    return Model(families, weights, b, float(temperature), {f: [triples(_words(x)) for x in notices] for f, notices in KNOWN.items()})


FOUND = "found array<struct<start: int, end: int, family: string, probability: double, likeness: double, confirmed: boolean>>"


def _scan(sent, least: float, alike: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        none = model.families.index(UNKNOWN)
        for whole in batches:
            for batch in parts(whole):
                t = Folded(batch.column("text"))
                text, start, end = pieces(t)
                found: list[list[dict]] = [[] for _ in range(t.n)]
                if len(start):
                    p = model.probabilities(t, start, end)
                    best = p.argmax(axis=1)
                    hit = np.flatnonzero((best != none) & (p[np.arange(len(p)), best] >= least))
                    hit = hit[np.lexsort((start[hit], best[hit], text[hit]))]
                    i = 0
                    while i < len(hit):
                        j, z = i, int(end[hit[i]])
                        while j + 1 < len(hit) and text[hit[j + 1]] == text[hit[i]] and best[hit[j + 1]] == best[hit[i]] and start[hit[j + 1]] <= z:
                            j += 1
                            z = max(z, int(end[hit[j]]))
                        a, doc, family = int(start[hit[i]]), int(text[hit[i]]), model.families[best[hit[i]]]
                        x, y = int(t.start[a]), int(t.end[z - 1])
                        like = likeness(t.data[x:y].tobytes().split(), model.triples[family])
                        found[doc].append({"start": x - int(t.at[doc]), "end": y - int(t.at[doc]), "family": family, "probability": float(p[hit[i : j + 1], best[hit[i]]].max()), "likeness": like, "confirmed": like >= alike})
                        i = j + 1
                n = np.bincount(text, minlength=t.n) if len(start) else np.zeros(t.n, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_pieces", "found"])

    return rows


def scan(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST, alike: float = ALIKE) -> DataFrame:
    """doc_id, n_pieces and FOUND (byte places of the text, family, probability, likeness, confirmed) for each row of docs (doc_id, text)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    some = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # of fixed size
    texts = [r["text"] for r in rows.join(F.broadcast(some), "doc_id").orderBy("doc_id", "text").limit(sample).collect()]
    sent = docs.sparkSession.sparkContext.broadcast(fit(texts))  # of fixed size
    return rows.mapInArrow(_scan(sent, least, alike), f"doc_id long, n_pieces long, {FOUND}")
