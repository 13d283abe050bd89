"""Documents within the edit bound, against a scan of all windows; recall for every shape of edits and length."""

import random

import numpy as np
import pytest

from quarry.llm import decontamination as dc
from tests.llm.helpers import clashing, documents, odd_texts, prose


def plain_nearest(item, text):
    """The distance matrix cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (t != w)))
        row = new
    return min(row), row.index(min(row))


def brute(texts, items, share=0.2):
    out = {}
    for d, t in enumerate(texts):
        ws = dc.words(t or "")
        for i, item in enumerate(items):
            iw = dc.words(item or "")
            if iw and (distance := plain_nearest(iw, ws)[0]) <= int(share * len(iw) + 1e-9):
                out[d, i] = distance
    return out


def edited(rng, ws, n):
    shape = rng.choice(list(dc.SHAPES))
    names = ["changedword", *ws]
    return [names[i] for i in dc.planted(np.arange(1, len(ws) + 1), n, shape, np.random.default_rng(rng.randrange(1 << 30)))]


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 300])
def test_matches_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block_bytes)
    rng = random.Random(12)
    items = [prose(rng, n) for n in (5, 6, 12, 20, 33, 60, 90, 40, 25)] + ["two words", "", None, "Who is it?", "river"]
    texts = [t if t is None else t[:2000] for t in odd_texts()] + ["two words", "Two, words!", "two words more", "not two or words", "who is it", "who is"]
    for i in range(70):
        ws = dc.words(items[i % 9])
        allowed = len(ws) // 5
        n = rng.choice([0, 1, allowed // 2, allowed, allowed, allowed + 1, allowed + 4])
        texts.append(prose(rng, rng.randint(0, 60)) + " " + " ".join(edited(rng, ws, n)) + " " + prose(rng, rng.randint(0, 60)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = dc.matches(clashing(documents(spark, texts)), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    want = brute(texts, items)
    assert len(got) == len(rows) and set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want)
    assert all(k in got for k, v in want.items() if v == 0 or len(dc.words(items[k[1]])) < 5)


@pytest.mark.parametrize("length", [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 16, 20, 30, 45, 80, 160, 400])
def test_recall_of_every_shape_of_edits(length):
    rng = np.random.default_rng(length)
    vocabulary = [f"w{k}" for k in range(1500)]
    items = [(k, " ".join(vocabulary[j] for j in rng.integers(0, 1500, length))) for k in range(20)]
    index = dc.Index(items, 0.2, 0.99)
    for shape in dc.SHAPES:
        texts = []
        for k in range(100):
            ids = np.array([vocabulary.index(w) + 1 for w in items[k % 20][1].split()])
            kept = dc.planted(ids, length // 5, shape, rng)
            texts.append(" ".join(["before it", *("new" if i == 0 else vocabulary[i - 1] for i in kept), "after it all"]))
        got = {(d, i) for d, i, *_ in index.find(texts)}
        assert sum((k, k % 20) in got for k in range(100)) >= 99, shape


def test_bit_vectors_equal_the_matrix():
    rng = np.random.default_rng(1)
    for _ in range(400):
        item, text = rng.integers(1, 6, int(rng.integers(1, 90))), rng.integers(0, 7, int(rng.integers(0, 60)))
        assert dc.nearest(item, text) == plain_nearest(item.tolist(), text.tolist())


def test_dropping(spark):
    rng = random.Random(2)
    item = prose(rng, 30)
    docs = documents(spark, [prose(rng, 100) + " " + item, prose(rng, 100), None, ""])
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    kept = dc.drop_contaminated(clashing(docs), bench)
    assert kept.columns == clashing(docs).columns
    assert sorted(kept.collect()) == sorted(clashing(docs).where("doc_id > 0").collect())
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 4
    assert dc.matches(docs.limit(0), bench).count() == 0
    nulls = docs.selectExpr("cast(null as long) as doc_id", "text")
    assert dc.drop_contaminated(nulls, bench).count() == 4


def test_walks_of_near_sequences_meet():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1000, 40)
    moved = np.delete(ids, 20)
    steps = np.sort(np.stack([rng.choice(40, 3, replace=False) for _ in range(60)]), axis=1)
    a = dc.walk(ids, np.array([0]), np.array([40]), steps)
    b = dc.walk(moved, np.array([0]), np.array([39]), steps)
    c = dc.walk(rng.integers(1, 1000, 40), np.array([0]), np.array([40]), steps)
    assert (a == b).mean() > 0.2 and (a == c).mean() < 0.05
