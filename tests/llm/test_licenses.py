"""Licence passages: families, spans, wrapped headers, short notices, unknown licences and ordinary text left alone."""

import random

import numpy as np
import pytest

from quarry.llm import licenses
from tests.llm.helpers import clashing, documents, odd_texts

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_families_and_spans(spark):
    lines = [("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0 (the \"License\").", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa")]
    texts = [f"A first paragraph of prose.\n\nAnd one more,\n{line}\nand prose\n\nThe end" for line, _ in lines] + ["\n\n".join(line for line, _ in lines)]
    got = {r["doc_id"]: r for r in licenses.scan(clashing(documents(spark, texts))).collect()}
    for i, (line, family) in enumerate(lines):
        r = got[i]
        assert (r["n_paragraphs"], r["n_licenses"], r["families"]) == (3, 1, family), line
        name, a, b = r["spans"].split(":")
        assert texts[i][int(a) : int(b)] in line and int(b) - int(a) >= len(line) - 18 and name == family and r["probability"] >= 0.5
    assert got[4]["n_licenses"] == 4 and got[4]["families"] == ",".join(sorted(f for _, f in lines))


@pytest.mark.parametrize("header, family", [(MIT, "mit"), (GPL, "gpl")])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
def test_wrapped_headers(header, family, mark):
    text = "\n".join(mark + line for line in header.split("\n"))
    assert [h[0] for h in licenses.classifier().paragraph(text, 0.5, 0.5)] == [family]


@pytest.mark.parametrize("text, family", [
    ("MIT License", "mit"), ("# Apache-2.0", "apache"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("This is licensed under the Boost Software License, Version 1.0.", "boost"),
    ("licensed under the Zlib license", "zlib"), ("Copyright 2024 Somebody. All rights reserved.", "proprietary"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
])
def test_short_notices(text, family):
    assert [h[0] for h in licenses.classifier().paragraph(text, 0.5, 0.5)] == [family]


@pytest.mark.parametrize("text", ["licensed under the Foobar license", "This software is licensed under the Quxley Public License, version 7.", "she has an MIT license for it", "all rights and all duties of members", "SPDX-License-Identifier: Nosuch-9.9"])
def test_unknown_licenses_and_mentions(text):
    assert licenses.classifier().paragraph(text, 0.5, 0.5) == []


def test_ordinary_text_is_unknown(spark):
    rows = licenses.scan(documents(spark, [*licenses.ORDINARY, *odd_texts()])).collect()
    assert all(r["n_licenses"] == 0 and r["families"] == "" and r["probability"] is None for r in rows)
    assert licenses.scan(documents(spark, ["x"]).limit(0)).count() == 0


def test_held_out_variants():
    rng, model = random.Random(77), licenses.classifier()
    right = total = 0
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            ws = licenses.words(t)
            if len(ws) < 8:
                continue
            for _ in range(5):
                v = [w for w in ws if rng.random() > 0.05]
                hit = model.predict(v, 0.5, 0.5)
                total += 1
                right += bool(hit) and hit[0] == family
    assert right >= 0.9 * total


def test_scan_equals_a_plain_reading(spark):
    """Every paragraph of a whole table classified by sums over its n-grams, without the words that choose paragraphs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["n_paragraphs"], r["spans"]) for r in licenses.scan(docs).collect()}
    model = licenses.classifier()
    for r in docs.collect():
        text, spans, n, at = r["text"] or "", [], 0, 0
        for line_block in __import__("re").split(r"(\n[^\S\n]*\n\s*)", text):
            if line_block.strip():
                n += 1
                for ws, places in model.passages(line_block):
                    z = model.b.copy()
                    known = [g for g in licenses.grams(ws) if g in model.index]
                    for g in known:
                        z += model.w[model.index[g]] / (np.sqrt(len(known)) + 1)
                    z = z / model.temperature
                    z[-1] += model.extra
                    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                    family = model.families[int(p.argmax())]
                    if family != licenses.UNKNOWN and p.max() >= 0.5:
                        shares = [sum(model.weight[g] for g in licenses.grams(t) & licenses.grams(ws)) / sum(model.weight[g] for g in licenses.grams(t)) for t in map(licenses.words, licenses.TEMPLATES[family])]
                        if max(shares) >= 0.5:
                            spans.append((family, at + places[0][0], at + places[-1][1]))
            at += len(line_block)
        mine = [s.split(":") for s in got[r["doc_id"]][1].split(",") if s]
        assert got[r["doc_id"]][0] == n and len(mine) == len(spans)
        assert all(f == g and a <= int(x) < int(y) <= b for (f, a, b), (g, x, y) in zip(spans, mine, strict=True))


def test_counts(spark):
    scanned = licenses.scan(documents(spark, ["Released under the MIT License.", "Released under the MIT License.\n\nLicensed under CC BY 4.0.", "no"]))
    assert {r["family"]: r["n"] for r in licenses.license_counts(scanned).collect()} == {"mit": 2, "cc-by": 1}
