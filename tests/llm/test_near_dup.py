"""SetSketch near-duplicates against all pairs."""

import random

import pytest

from quarry.llm import near_dup
from tests.llm.helpers import clashing, documents, odd_texts, prose


def sets(text):
    w = near_dup.words(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, percent):
    s = [sets(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i), find(i) == i) for i in range(len(s))}


def corpus():
    rng = random.Random(7)
    texts = odd_texts()
    for _ in range(12):
        base = prose(rng, rng.randint(8, 300)).split(" ")
        for _ in range(rng.randint(1, 9)):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 40))):
                v[rng.randrange(len(v))] = rng.choice(["changed", "other", "word"])
            texts.append(" ".join(v))
    hot = prose(rng, 120)
    texts += [hot] * 60 + [hot + " " + str(i) for i in range(60)]
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    for percent in (85, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(clashing(documents(spark, texts)), percent).collect()}
        assert got == brute(texts, percent)


@pytest.mark.parametrize("fan, block", [(2, 2), (5, 3)])
def test_small_tiles(spark, fan, block):
    """Hubs with several salts, buckets of several blocks and slices."""
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(documents(spark, texts), 80, fan=fan, block=block).collect()}
    assert got == brute(texts, 80)


def test_two_groups_that_share_all_buckets(spark):
    """Chains of near copies: members link with their neighbours only, so stars leave much to the tiles."""
    rng = random.Random(4)
    words = prose(rng, 200).split(" ")
    texts = [" ".join(words[:k] + [f"new{j}" for j in range(k)] + words[2 * k :]) for k in range(0, 60, 2)]
    want = brute(texts, 80)
    for block in (2, near_dup.BLOCK):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(documents(spark, texts), 80, block=block).collect()}
        assert got == want


def test_empty_null_and_repeated(spark):
    docs = documents(spark, ["a b c d e f", None])
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    twice = near_dup.near_duplicates(docs.union(docs)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in twice) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    nulls = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "only here so it is alone")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(nulls).collect()} == {(None, 3, False), (3, 3, True), (None, None, False)}
    assert near_dup.keep_first(nulls).count() == 3


def test_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(2)
    whole = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.unique(whole[:1000]), np.unique(whole[1000 - n : 2000 - n])
        x = near_dup.sketches([a, b])
        got = near_dup.estimate(x[:1], x[1:], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(got - share) < 0.12


def test_sketches_merge():
    import numpy as np

    s = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 500).astype(np.uint64))
    a, b, both = near_dup.sketches([s[:300], s[200:], s])
    assert (np.maximum(a, b) == both).all()
