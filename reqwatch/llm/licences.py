"""Licence scans: a trained paragraph classifier over sparse word n-grams.

Each paragraph (a line with a word) becomes hashed one- and two-word features.  Multinomial logistic regression, trained
on templates of public licences amid words of the corpus, names its family or none of them.  The least probability that
counts is calibrated on paragraphs, templates and whole families that the fit has not seen; below it the family is
unknown.  A named family stands only if the paragraph shares enough word pairs with one of the family's templates, one
that no other family has among them, and is at least as close to it as to any other such template.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, text_slices, word_hashes

#: Wording of public licences and of the notices that name them, a paragraph each.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004",
        "License: Apache-2.0",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "This file is licensed under the Apache 2 license.",
        "Apache 2.0 licensed.",
        "Distributed under the Apache License 2.0; see the NOTICE file.",
        "Available under the Apache-2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "The MIT License (MIT)",
        "License: MIT",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under MIT.",
        "Licensed under the MIT license, see LICENSE for details.",
        "Distributed under the MIT license.",
        "MIT licensed.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "License: GPL-3.0",
        "Licensed under the GPLv3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "License: GPL v3 or later",
        "Released under GPL version 2 or later.",
        "Distributed under the GPL v2.",
        "Licensed under GPL.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Licensed under the LGPL version 3.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "License: LGPL v2.1 or later",
        "Released under LGPL version 3 or later.",
        "Distributed under the GNU LGPL.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the AGPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "License: AGPL v3 or later",
        "Released under the GNU AGPL version 3.",
        "Distributed under the AGPL.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES, HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the 2-clause BSD license.",
        "Licensed under BSD.",
        "License: BSD-3-Clause",
        "Distributed under the BSD license.",
        "BSD licensed.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Released under the MPL 2.0.",
        "License: MPL-2.0",
        "Distributed under the MPL.",
        "Licensed under the MPL 2.0.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
        "License: ISC",
        "Released under the ISC license.",
        "ISC licensed.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This article is available under the Creative Commons CC BY 3.0 license.",
        "License: CC BY 4.0",
        "Published under a CC BY licence.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License 3.0; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Released under CC BY-SA 3.0.",
        "License: CC BY-SA 4.0",
        "Published under a CC BY-SA licence.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution-NonCommercial License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Released under CC BY-NC 3.0 for non-commercial use.",
        "License: CC BY-NC 4.0",
        "Published under a CC BY-NC licence.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "The person who associated a work with this deed has dedicated the work to the public domain under CC0 1.0 Universal.",
        "Released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work has been marked as dedicated to the public domain.",
        "Released under CC0.",
        "License: CC0-1.0",
        "CC0 1.0 Universal",
        "Dedicated to the public domain.",
    ],
}
FAMILIES = sorted(TEMPLATES)
NONE = len(FAMILIES)
#: About so many documents lend paragraphs that are no licences, at most so many of them.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, EXAMPLES, PRECISION, SEED = 2_000, 4_000, 240, 0.995, 3
#: Every so manyth family, template of a family and paragraph is unseen by the fit that calibrates.
UNSEEN = 4
#: Part of the paragraph's word pairs, or of a template's, that must be the other's.
SHARED = 0.6
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not (chr(c).isalnum() or c in (10, 13))]] = 32
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word pairs of each row, punctuation aside: (hashes, rows, whether a pair), words before pairs."""
    words, counts = word_hashes(_PLAIN[raw], offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        pairs = mix64(words[:-1] * _PAIR + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    same = row[1:] == row[:-1]
    return np.concatenate([words, pairs[same]]), np.concatenate([row, row[1:][same]]), np.repeat([False, True], [len(words), int(same.sum())])


def _of(paragraphs: list[str]):
    data = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
    raw = np.frombuffer(b"".join(data), np.uint8)
    return features(raw, np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64))


@dataclass
class Classifier:
    known: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # by feature, then one row for the share of unknown features and one for the bias; by family and none
    least: float = 0.5

    def probabilities(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        total = np.maximum(np.bincount(rows, minlength=n), 1)
        z = np.zeros((n, self.weights.shape[1]))
        order = np.flatnonzero(hit)
        for k in range(z.shape[1]):
            z[:, k] = np.bincount(rows[order], self.weights[at[order], k], n)
        z /= np.sqrt(total)[:, None]
        z += self.weights[-1] + (1 - np.bincount(rows[order], minlength=n) / total)[:, None] * self.weights[-2]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


class Templates:
    """Word pairs of templates, for the comparison that confirms a prediction."""

    def __init__(self, templates: dict[str, list[str]]):
        texts = [(f, t) for f in FAMILIES for t in templates[f]]
        hashes, rows, pair = _of([t for _, t in texts])
        self.family = np.array([FAMILIES.index(f) for f, _ in texts])
        self.pairs, at = np.unique(hashes[pair], return_inverse=True)
        self.holds = np.zeros((len(self.pairs), len(texts)), np.float32)
        self.holds[at, rows[pair]] = 1
        known_to = np.stack([self.holds[:, self.family == k].any(axis=1) for k in range(NONE)]).sum(axis=0)
        self.telling = np.where((known_to == 1)[:, None], self.holds, 0)  # pairs of one family alone
        self.weight = np.where(known_to == 1, 2, 1)

    def confirmed(self, pairs: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Which families the word pairs of each of n rows confirm, as booleans.

        Those of the closest template that shares enough of them, one that no other family has among them.  Two pairs must
        be shared, or the only one that the row, such as a title, or the template has.
        """
        order = np.lexsort((pairs, rows))
        pairs, rows = pairs[order], rows[order]
        fresh = np.append(True, (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1]))[: len(pairs)]
        pairs, rows = pairs[fresh], rows[fresh]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        hit = self.pairs[at] == pairs
        both, own, size = np.zeros((n, len(self.family)), np.float32), np.bincount(rows, minlength=n)[:, None], self.holds.sum(axis=0)
        np.add.at(both, rows[hit], self.holds[at[hit]])
        told = np.zeros_like(both)
        np.add.at(told, rows[hit], self.telling[at[hit]])
        enough = (told > 0) & (both >= SHARED * np.minimum(own, size)) & (both >= np.minimum(2, np.minimum(own, size)))
        near = np.where(enough, both / np.maximum(own + size - both, 1), 0)
        best = near.max(axis=1, keepdims=True)
        out = np.zeros((n, NONE), bool)
        for k in range(NONE):
            out[:, k] = ((near == best) & (best > 0))[:, self.family == k].any(axis=1)
        return out


def _examples(rng: np.random.Generator, words: list[str], templates: dict[str, list[str]] = TEMPLATES, each: int = EXAMPLES) -> tuple[list[str], list[int]]:
    """Templates with words dropped, cut short, changed in case, or amid other words; of each family as many."""
    texts, labels = [], []
    for k, family in enumerate(FAMILIES):
        for _ in range(each if templates[family] else 0):
            t = templates[family][rng.integers(len(templates[family]))].split()
            if rng.random() < 0.4 and len(t) > 6:
                t = [w for w in t if rng.random() > 0.1]
            if rng.random() < 0.3 and len(t) > 16:
                at = rng.integers(0, len(t) - 12)
                t = t[at : at + 12 + rng.integers(0, 12)]
            if words and rng.random() < 0.4:
                t = [*rng.choice(words, rng.integers(1, 6)), *t]
            if words and rng.random() < 0.4:
                t = [*t, *rng.choice(words, rng.integers(1, 6))]
            text = " ".join(t)
            texts.append(text.upper() if rng.random() < 0.1 else text)
            labels.append(k)
    return texts, labels


#: Everyday prose with words of licences, which is none.
_OTHERS = [
    "The software was released in May and the license plate was found.", "She obtained permission to use the hall for a free concert.", "The general public may use this version of the park map.",
    "A copy of the report is included with this letter.", "The following conditions are met by most of the source material.", "They were licensed to drive and sell under the new act.",
    "All rights reserved.", "Copyright 2020 the authors.", "Terms and conditions apply.", "The work is provided for a particular purpose without warranty of success.",
]


def _fitted(texts: list[str], labels: np.ndarray, templates: dict[str, list[str]]) -> Classifier:
    """A classifier by the words and word pairs of templates; all others count as unknown ones."""
    hashes, rows, _ = _of(texts)
    known = np.unique(_of([t for ts in templates.values() for t in ts])[0])
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    total = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
    scale, unknown = (1 / np.sqrt(total)).astype(np.float32), (1 - np.bincount(rows[hit], minlength=len(texts)) / total).astype(np.float32)
    # the sparse matrix as (row, feature) pairs in either order
    row, feature = rows[hit], at[hit]
    by_row, by_feature = np.argsort(row, kind="stable"), np.argsort(feature, kind="stable")
    own, heads = np.unique(row[by_row], return_index=True)
    used, firsts = np.unique(feature[by_feature], return_index=True)
    w = np.zeros((len(known) + 2, NONE + 1), np.float32)
    step, y, grad = np.zeros_like(w), np.eye(NONE + 1, dtype=np.float32)[labels], np.zeros_like(w)
    for _ in range(150 if len(texts) else 0):
        ahead = w + 0.9 * step
        z = np.zeros_like(y)
        if len(own):
            z[own] = np.add.reduceat(ahead[feature[by_row]], heads, axis=0)
        z = z * scale[:, None] + unknown[:, None] * ahead[-2] + ahead[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        miss = (z / z.sum(axis=1, keepdims=True) - y) / len(texts)
        if len(used):
            grad[used] = np.add.reduceat((miss * scale[:, None])[row[by_feature]], firsts, axis=0)
        grad[-2], grad[-1] = unknown @ miss, miss.sum(axis=0)
        step = 0.9 * step - 4.0 * (grad + 1e-5 * w)
        w = w + step
    return Classifier(known, w.astype(np.float64))


def named(model: Classifier, templates: Templates, hashes: np.ndarray, rows: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the likeliest family, its probability, whether it is none at all, and whether a template confirms the family.

    Rows for which none is likelier than each family are none, as are those with no word pair of a single family's
    templates and fewer than two pairs of any.
    """
    p = model.probabilities(hashes, rows, n)
    at = np.minimum(np.searchsorted(templates.pairs, hashes[pair]), len(templates.pairs) - 1)
    known = np.bincount(rows[pair], np.where(templates.pairs[at] == hashes[pair], templates.weight[at], 0), n) >= 2
    best, likely = p[:, :NONE].argmax(axis=1), known & (p.argmax(axis=1) != NONE)
    own = pair & likely[rows]  # only these are compared
    return best, p[np.arange(n), best], ~likely, templates.confirmed(hashes[own], rows[own], n)[np.arange(n), best]


def train(others: list[str], seed: int = SEED) -> Classifier:
    """others: paragraphs of the corpus, taken as none unless a template confirms them.

    A first fit leaves out some families, which are unknown to it, some templates of others, and some paragraphs; on these
    the least probability is found at which named families are right often enough.  The fit that counts takes all.
    """
    rng = np.random.default_rng(seed)
    others = others + _OTHERS * 20
    hashes, rows, pair = _of(others)
    clean = [t for t, known in zip(others, Templates(TEMPLATES).confirmed(hashes[pair], rows[pair], len(others)).any(axis=1), strict=True) if not known]
    words = sorted({w for t in clean[:500] for w in t.split()})
    foreign = FAMILIES[UNSEEN - 1 :: UNSEEN]
    unseen = {f: t if f in foreign else t[UNSEEN - 1 :: UNSEEN] for f, t in TEMPLATES.items()}
    seen = {f: [t for t in TEMPLATES[f] if t not in unseen[f]] for f in FAMILIES}
    held = rng.permutation(len(clean)) % UNSEEN == 0
    kept, left = [t for t, h in zip(clean, held, strict=True) if not h], [t for t, h in zip(clean, held, strict=True) if h]
    texts, labels = _examples(rng, words, seen)
    first = _fitted(texts + kept, np.array(labels + [NONE] * len(kept)), seen)
    (texts, labels), (new, own) = _examples(rng, words, seen, EXAMPLES // UNSEEN), _examples(rng, words, unseen, EXAMPLES // UNSEEN)
    labels = np.array(labels + [NONE if FAMILIES[k] in foreign else k for k in own] + [NONE] * len(left))
    best, top, none, sure = named(first, Templates(seen), *_of(texts + new + left), len(labels))
    levels = [t for t in np.linspace(0.2, 0.99, 80) if (labels == best)[sure & ~none & (top >= t)].mean() >= PRECISION] if (sure & ~none & (top >= 0.99)).any() else []
    texts, labels = _examples(rng, words)
    model = _fitted(texts + clean, np.array(labels + [NONE] * len(clean)), TEMPLATES)
    model.least = float(levels[0]) if levels else 0.99
    return model


def _paragraph_batches(batches):
    for batch in batches:
        rows = [(h, line) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True) for line in t.split("\n") if line.strip()]
        h, line = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "line": pa.array(line, pa.string())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Trains amid paragraphs, of fewer than 2000 characters, of about sample_docs rows; rows without a text lend none."""
    h = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 30))
    rows = docs.select(h.alias("h"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.where(F.col("h") < min(1.0, sample_docs / max(1, docs.count())) * (1 << 30))
    lines = rows.mapInArrow(_paragraph_batches, "h long, line string").where(F.length("line") < 2000).orderBy(F.xxhash64("h", "line"), "line").limit(SAMPLE_PARAGRAPHS)
    return train([r.line for r in lines.collect()])


def _scan_batches(batches, model: Classifier):
    templates = Templates(TEMPLATES)
    for batch in batches:
        ids = batch.column("doc_id")
        for at, n, raw, offsets in text_slices(ids, batch.column("text")):
            breaks = np.flatnonzero(raw == 10) + 1
            bounds = np.union1d(breaks, offsets)
            bounds = bounds if len(bounds) > 1 else np.array([0, len(raw)])
            hashes, rows, pair = features(raw, bounds.astype(np.int64))
            lines = len(bounds) - 1
            real = np.bincount(rows[~pair], minlength=lines) > 0
            owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
            paragraphs = np.bincount(owner[real], minlength=n)[:n]
            best, top, none, sure = named(model, templates, hashes, rows, pair, lines)
            found: dict[int, list[tuple[str, int, int, float]]] = {}
            points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
            for k in np.flatnonzero(real & ~none):
                family = FAMILIES[best[k]] if top[k] >= model.least and sure[k] else "unknown"
                doc = int(owner[k])
                start = int(points[bounds[k]] - points[offsets[doc]])
                line = raw[bounds[k] : bounds[k + 1]].tobytes().rstrip(b"\n").decode("utf-8", "replace")
                found.setdefault(doc, []).append((family, start, start + len(line), float(top[k])))
            out = []
            for k in range(n):
                spans = found.get(k, [])
                sound = [s for s in spans if s[0] != "unknown"]
                first = max(sound, key=lambda s: (s[3], -s[1]))[0] if sound else ("unknown" if spans else None)
                out.append((int(paragraphs[k]), len(sound), len(spans) - len(sound), first, ",".join(sorted({s[0] for s in sound})), ",".join(f"{f}:{a}:{b}" for f, a, b, _ in spans)))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["n_paragraphs", "n_named", "n_unknown", "licence", "families", "spans"]
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, n)} | {c: pa.array(v, t) for c, v, t in zip(names, cols, kinds, strict=True)})


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_named, n_unknown, licence, families, spans), one row per row of docs.

    licence: the likeliest confirmed family, `unknown` where paragraphs look like a licence but none is confirmed, null
    where none does, as in null and empty texts.  spans: family:start:end in code points.  Rows are judged one by one, so
    null and repeated ids stay as they are, and other columns, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand features by a dozen families
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan_batches(it, shared.value), "doc_id long, n_paragraphs long, n_named long, n_unknown long, licence string, families string, spans string")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
