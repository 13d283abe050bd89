"""The classifier: held-out accuracy, its parts, odd inputs."""

import numpy as np
import pytest

from quarry.llm import quality
from quarry.llm.common import Hashes, mix64
from tests.llm.helpers import clashing, documents, odd_texts


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    held = docs.join(labels, "doc_id").where(quality.fold(docs["doc_id"]) == 0)
    scored = quality.score(held.select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    assert scored["held_out"].all()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert (good.predicted == 1).mean() >= 0.95 and (bad.predicted == 0).mean() >= 0.8
    ranks = scored.score.rank()
    auc = (ranks[scored.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc >= 0.95


def test_odd_texts_and_labels(spark):
    docs = documents(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, None, 0), (None, 1, 0), (99, 1, 1), (5, 1, 0), (5, 1, 0), (6, 0, 0), (8, 1, 0), (9, 0, 0), (10, 1, 0), (11, 1, 0), (7, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd, odd.where("quality = 1")):
        model = quality.learn(clashing(docs), labels)
        rows = quality.score(clashing(docs), model).collect()
        assert len(rows) == len(odd_texts())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        kept = quality.keep_good(clashing(docs), model)
        assert kept.columns == clashing(docs).columns
        assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_equal_a_plain_reading(spark):
    """The margin of each text summed over a set of its indicators, token by token."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    hashes = Hashes()
    kinds = quality._Kinds(hashes)
    top = lambda x: int(mix64(np.array([x], dtype=np.uint64))[0] >> np.uint64(64 - quality.BITS))
    for r in docs.limit(60).collect():
        ts = quality._TOKEN.findall(r["text"] or "")
        ids = [hashes[t] for t in ts]
        ks = [quality.REPEAT if i and ids[i] == ids[i - 1] else kinds[t] for i, t in enumerate(ts)]
        f = {top(x) for x in ids} | {top((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(ids, ids[1:], strict=False)}
        share = {}
        for cell in ks + [quality.KINDS + a * quality.KINDS + b for a, b in zip(ks, ks[1:], strict=False)]:
            share[cell] = share.get(cell, 0) + 1
        for cell, n in share.items():
            f.add((1 << quality.BITS) + cell * quality.LEVELS + min(quality.LEVELS - 1, int(-np.floor(np.log2(n / len(ts))))))
        at = sorted(f)
        margin = model.weights[at].astype(np.float32).sum(dtype=np.float64) / (np.sqrt((model.ratios[at] ** 2).sum()) + 1e-9) if at else 0.0
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-4


def test_what_is_read_to_the_driver_is_bounded(spark):
    docs = documents(spark, [f"word{i} and more of it" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    repeated = docs.union(docs).union(docs)
    a, b = quality.learn(docs, labels), quality.learn(repeated, labels)
    assert (a.weights == b.weights).all() and a.slope == b.slope
    assert len(quality.learn(docs, labels, most_indicators=0).weights) == quality.SIZE
    assert np.count_nonzero(quality.learn(docs, labels, most=4).ratios) <= np.count_nonzero(a.ratios)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(200, 20, replace=False)).astype(np.int32) + (i % 2) * 40 for i in range(80)]
    y = np.arange(80) % 2
    few, _ = quality._linear(rows, y, 1.0, 60, 5)
    many, _ = quality._linear(rows, y, 1.0, 600, 6)
    assert np.allclose(few, many, atol=2e-2)


@pytest.mark.parametrize("text", ["Words, words!", "AA bb 12 12", ""])
def test_indicators_are_sorted_and_distinct(text):
    h = Hashes()
    f = quality.features([text, "other"], h, quality._Kinds(h))
    assert (np.diff(f[0]) > 0).all() and len(f) == 2 and (len(f[0]) > 0) == bool(text)
