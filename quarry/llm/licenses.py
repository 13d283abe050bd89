"""License scans: a sparse word n-gram logistic regression over passages of paragraphs, trained on templates, on licences whose
name is replaced and on ordinary text; unknown licences calibrate it, and a comparison with the family's templates confirms it."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, text_batches

TEMPLATES: dict[str, list[str]] = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the Apache License, Version 2.0.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0", "Apache-2.0"],
    "mit": ["Released under the MIT License.", "This software is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT", "MIT License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-only", "GNU Lesser General Public License"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU Affero General Public License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the CC BY license.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "ISC License"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "Licensed under the zlib license.", "SPDX-License-Identifier: Zlib"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "Licensed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Boost Software License Version 1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, Version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License 2.0"],
    "proprietary": ["Copyright, all rights reserved. No part of this publication may be reproduced without written permission.", "All rights reserved."],
}
#: Ordinary sentences, some with words that licences use too.
ORDINARY = """the driver renewed a fishing license before the season opened|version 2.0 of the report was released on monday
the public library is open to any person free of charge|general conditions of the market improved in march
the committee granted permission to build the road|we used a simple source of light and a copy of the map
he worked under the terms of the old agreement|the common form of the word is used without change
she studied at mit before she moved to berkeley|the apache people lived in the southwest of the country
a free software course starts in autumn|all rights and duties of members are listed below
the mozilla office closed for the day|eclipse of the sun was seen from the coast
in the general case the work is hard and slow|you may not use this door except in an emergency
this program is shown on television at eight|the materials are available in the shop
attribution of the painting is still disputed|commercial traffic grew while public transport did not
the new version is better than the old one|she read the page and put the book down
with or without sugar the tea is good|cc the manager and by noon send the list
isc and bsd were mentioned in passing|the foundation published a report on water
le projet est sous la direction de la ville|der text ist unter der leitung von allen
el trabajo de la casa es de todos|the file was copied and the folder deleted
no part of the trip was easy|any purpose will do if the fee is low
international trade and the share of the state|no derivatives were traded on the exchange""".replace("\n", "|").split("|")

_WORD = re.compile(r"[^\W_]+(?:[.+]\d+)*")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
UNKNOWN = "unknown"
#: Words between parts of one passage that no template has side by side; passages this short count only as a whole line.
GAP, SHORT = 3, 4


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(ws: list[str]) -> set[str]:
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)), *(f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:], strict=False))}


class Classifier:
    """Weights of n-grams for each family and for unknown, and the templates that predictions are compared with."""

    def __init__(self, seed: int = 4, variants: int = 8, epochs: int = 60, folds: int = 3):
        rng = random.Random(seed)
        names = list(TEMPLATES)
        self.families = [*names, UNKNOWN]
        parsed = {f: [words(t) for t in ts] for f, ts in TEMPLATES.items()}
        holders: dict[str, set[str]] = defaultdict(set)
        for f, ts in parsed.items():
            for ws in ts:
                for g in grams(ws):
                    holders[g].add(f)
        # what fewer families have says more
        self.weight = {g: math.log(1 + len(names) / len(h)) for g, h in holders.items()}
        self.own = {g for g, h in holders.items() if len(h) == 1 and " " not in g}
        self.templates = {f: [(s := frozenset(grams(ws)), sum(self.weight[g] for g in s)) for ws in ts] for f, ts in parsed.items()}
        self.pairs = {g for g in holders if g.count(" ") == 1}
        self.anchors = self._anchors(parsed)
        rows = self._rows(rng, parsed, variants)
        # unknown is calibrated on families that a fit has not seen: what it gives them, and held-out variants of all others
        logits, truth = [], []
        for fold in range(folds):
            hidden = {k for k in range(len(names)) if k % folds == fold}
            fitted = [r for i, r in enumerate(rows) if r[1] not in hidden and i % 5]
            index, w, b = self._fit(fitted, epochs)
            for i, (g, k) in enumerate(rows):
                if k in hidden or i % 5 == 0:
                    z = _logits(g, index, w, b)
                    z[list(hidden)] = -30
                    logits.append(z)
                    truth.append(len(names) if k in hidden else k)
        z, y = np.array(logits), np.array(truth)
        best = (-np.inf, 1.0, 0.0)
        for t in np.linspace(0.3, 3, 19):
            for extra in np.linspace(-2, 4, 25):
                v = z / t
                v[:, -1] += extra
                v -= v.max(1, keepdims=True)
                best = max(best, (float((v[np.arange(len(y)), y] - np.log(np.exp(v).sum(1))).mean()), float(t), float(extra)))
        _, self.temperature, self.extra = best
        self.index, self.w, self.b = self._fit(rows, epochs)

    @staticmethod
    def _anchors(parsed: dict[str, list[list[str]]]) -> re.Pattern:
        """Few words of which every template has one: only paragraphs with one of them are looked at."""
        left, chosen = [set(ws) for ts in parsed.values() for ws in ts], []
        common = {"the", "of", "to", "and", "or", "in", "a", "is", "this", "you", "it", "that", "for", "by", "be", "with", "from", "on", "any", "no", "use", "at", "can", "are", "all", "not", "may"}
        while left:
            counts: dict[str, int] = defaultdict(int)
            for s in left:
                for w in s - common:
                    counts[w] += 1
            word = max(sorted(counts), key=counts.get)
            chosen.append(word)
            left = [s for s in left if word not in s]
        return re.compile("|".join(re.escape(w) for w in sorted(chosen)), re.IGNORECASE)

    def _rows(self, rng: random.Random, parsed: dict[str, list[list[str]]], variants: int) -> list[tuple[set[str], int]]:
        filler = [w for s in ORDINARY for w in s.split()]
        shared = [w for ts in parsed.values() for ws in ts for w in ws]
        rows: list[tuple[set[str], int]] = []
        unknown = len(parsed)
        for k, ts in enumerate(parsed.values()):
            for ws in ts:
                rows.append((grams(ws), k))
                for _ in range(variants):
                    v = [w for w in ws if rng.random() > 0.08] or ws
                    cut = rng.randint(0, len(v) // 4)
                    v = v[cut:] if rng.random() < 0.5 else v[: len(v) - cut]
                    rows.append((grams(v), k) if any(w in self.own for w in v) or len(ws) > 8 else (grams(ws), k))
                bare = [w for w in ws if w not in self.own]  # another licence's name in its place
                if len(bare) < len(ws):
                    for _ in range(3):
                        name = "".join(rng.choice("abcdeiklmnorstu") for _ in range(rng.randint(3, 8)))
                        v = [name if w in self.own else w for w in ws]
                        rows.append((grams(v if len(ws) <= 12 else v[: rng.randint(4, 9)]), unknown))
        for _ in range(12):
            for s in ORDINARY:
                v = s.split()
                rng.shuffle(v) if rng.random() < 0.3 else None
                for _ in range(rng.randint(0, 2)):
                    v.insert(rng.randint(0, len(v)), rng.choice(shared))
                rows.append((grams(v), unknown))
                rows.append((grams([rng.choice(filler) for _ in range(6)]), unknown))
        return rows

    def _fit(self, rows: list[tuple[set[str], int]], epochs: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Full-batch Adam over rows as lists of indices; only the n-grams that a row has are touched."""
        count: dict[str, int] = defaultdict(int)
        for g, _ in rows:
            for x in g:
                count[x] += x in self.weight
        index = {g: i for i, g in enumerate(sorted(x for x, n in count.items() if n >= 2))}
        lists = [sorted(index[q] for q in g if q in index) for g, _ in rows]
        sizes = np.array([len(x) for x in lists])
        flat = np.array([i for x in lists for i in x], dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        value = (1 / (np.sqrt(sizes) + 1))[row]
        by_feature = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by_feature], np.arange(len(index)))
        full = np.flatnonzero(sizes)
        row_starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][full]
        y = np.eye(len(self.families))[[k for _, k in rows]]
        per = y.sum(0)
        scale = (y / np.maximum(per, 1) / max(1, (per > 0).sum())).sum(1, keepdims=True)
        w, b = np.zeros((len(index), y.shape[1])), np.zeros(y.shape[1])
        first, second = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
        for t in range(1, epochs + 1):
            z = np.tile(b, (len(rows), 1))
            z[full] += np.add.reduceat(w[flat] * value[:, None], row_starts, axis=0)
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            d = (p - y) * scale
            gw = np.add.reduceat(d[row[by_feature]] * value[by_feature][:, None], starts, axis=0) + 1e-6 * w
            for k, (param, g) in enumerate(((w, gw), (b, d.sum(0)))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                param -= 0.3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-10)
        return index, w, b

    def predict(self, ws: list[str], least: float, near: float) -> tuple[str, float, frozenset[str]] | None:
        """(family, probability, n-grams of the template) of a passage where the prediction is known and a template confirms it: at least ``near`` of the
        template's n-grams, weighted by how few families have them, are in the passage. Of families alike the first is taken."""
        g = grams(ws)
        z = _logits(g, self.index, self.w, self.b) / self.temperature
        z[-1] += self.extra
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        if k == len(TEMPLATES) or p[k] < least:
            return None
        shares = [(sum(self.weight[q] for q in t & g), t, whole) for t, whole in self.templates[self.families[k]]]
        confirmed = [(found, t) for found, t, whole in shares if found >= near * whole]
        return (self.families[k], float(p[k]), max(confirmed, key=lambda c: c[0])[1]) if confirmed else None

    def passages(self, text: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
        """Runs of words, with their places in the text, that templates have side by side, over line ends and comment marks."""
        ms = list(_WORD.finditer(text))
        ws = [m.group().lower() for m in ms]
        known = [f"{a} {b}" in self.pairs for a, b in zip(ws, ws[1:], strict=False)]
        at = [i for i, k in enumerate(known) if k]
        begin = 0
        while begin < len(at):
            end = begin
            while end + 1 < len(at) and at[end + 1] - at[end] <= GAP + 1:
                end += 1
            i, j = at[begin], at[end] + 1
            if j - i + 1 > SHORT or _alone(text, ms[i].start(), ms[j].end()):
                yield ws[i : j + 1], [m.span() for m in ms[i : j + 1]]
            begin = end + 1

    def paragraph(self, text: str, least: float, near: float) -> list[tuple[str, int, int, float]]:
        """(family, start, end, probability) of the licence passages of a paragraph, cut to what the template has."""
        out = []
        for ws, places in self.passages(text):
            if hit := self.predict(ws, least, near):
                family, p, template = hit
                own = [i for i, (a, b) in enumerate(zip(ws, ws[1:], strict=False)) if f"{a} {b}" in template] or [0, len(ws) - 2]
                out.append((family, places[own[0]][0], places[own[-1] + 1][1], p))
        return out


def _alone(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is a whole sentence or line but for marks."""
    before = re.split(r"[.!?:;]\s|\n", text[max(0, a - 200) : a])[-1]
    after = re.split(r"[.!?:;](?=\s|$)|\n", text[b : b + 200])[0]
    return not _WORD.search(before) and not _WORD.search(after)


def _logits(g: set[str], index: dict[str, int], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = [index[q] for q in g if q in index]
    return w[at].sum(0) / (math.sqrt(len(at)) + 1) + b


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier()


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Where paragraphs begin and end: text between blank lines that has other characters than white space."""
    cuts = [0, *(x for m in _BLANK.finditer(text) for x in m.span()), len(text)]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if text[a:b].strip()]


def scan(docs: DataFrame, least: float = 0.5, near: float = 0.5) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses, families, spans, probability for every row of ``docs(doc_id, text)``.

    Paragraphs lie between blank lines, however their lines are wrapped and whatever comment marks begin them. A licence passage is a run of
    a paragraph's words that templates have side by side (short ones only if they fill their lines) whose most likely
    family is not unknown, has a probability of at least ``least``, and holds at least ``near`` of the weight of one of its templates.
    families: the sorted distinct families, spans: family:start:end (code points, end exclusive, by start), both comma-joined and
    empty where none is found; probability: the largest, or null. Null and empty texts have no paragraphs; a family that is as
    likely as another is the first of the two in ``TEMPLATES``; repeated rows are kept; an empty table gives no rows; further
    columns are ignored. A narrow map over whole texts; the classifier is trained once and sent to the executors (under 2 MB).
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = sent.value
        for ids, texts in text_batches(batches, "doc_id", "text"):
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                hits: list[tuple[str, int, int, float]] = []
                parts = paragraphs(text)
                marks = [m.start() for m in model.anchors.finditer(text)]
                k = 0
                for a, b in parts if marks else ():
                    while k < len(marks) and marks[k] < a:
                        k += 1
                    if k < len(marks) and marks[k] < b:
                        hits += [(f, a + i, a + j, p) for f, i, j, p in model.paragraph(text[a:b], least, near)]
                rows.append((doc, len(parts), len(hits), ",".join(sorted({h[0] for h in hits})), ",".join(f"{f}:{a}:{b}" for f, a, b, _ in hits), max((h[3] for h in hits), default=None)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_paragraphs", "n_licenses", "families", "spans", "probability"])

    return documents(docs).mapInArrow(run, "doc_id long, n_paragraphs long, n_licenses long, families string, spans string, probability double")


def license_counts(scanned: DataFrame) -> DataFrame:
    """Documents of each family."""
    return scanned.select(F.explode(F.split("families", ",")).alias("family")).where("family <> ''").groupBy("family").agg(F.count("*").alias("n"))
