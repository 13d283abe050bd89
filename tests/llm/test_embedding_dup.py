"""Embedding near-duplicates against all pairs within labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import embedding_dup
from tests.compare import differences, duck


def brute(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, (np.array(v, dtype=float), label))
    ids = list(ok)
    links = {i: set() for i, _, _ in rows}
    for a in ids:
        for b in ids:
            (x, p), (y, q) = ok[a], ok[b]
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for a in links:
            low = min([comp[a], *(comp[b] for b in links[a])])
            if low != comp[a]:
                comp[a], changed = low, True
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [embedding_dup.BLOCK, 16, 3])
def test_links_equal_brute_force(spark, block):
    """With small blocks, also buckets that are split, tiles of several blocks and slices, and many tables."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            center = rng.normal(size=12)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n, [float(np.float32(x)) for x in center + rng.normal(size=12) * rng.choice([0.02, 0.15, 0.28])], label))
                n += 1
    hot = rng.normal(size=12)
    for _ in range(80):
        rows.append((n, [float(np.float32(x)) for x in hot], 1))
        rows.append((n + 1, [float(np.float32(x)) for x in hot + rng.normal(size=12) * 0.2], 1))
        n += 2
    rows += [(n, None, 0), (n + 1, [0.0] * 12, 0), (n + 2, [1.0] * 11 + [None], 0), (n + 3, [float("nan")] * 12, 0), (n + 4, [float("inf")] + [1.0] * 11, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [1e-30] * 12, 0), (n + 9, [1e30] * 12, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.near_duplicates(table(spark, rows).withColumn("unit", F.lit(1)).withColumn("w", F.lit("x")), 0.93, block=block).collect()}
    want = brute(rows, 0.93)
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_empty_and_repeated(spark):
    one = table(spark, [(1, [1.0, 2.0], 3), (2, [2.0, 1.0], 3)])
    assert embedding_dup.near_duplicates(one.limit(0)).count() == 0
    twice = embedding_dup.near_duplicates(one.union(one)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in twice) == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (2, 1, 2)]


def found(spark, rows, **more):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.near_duplicates(table(spark, rows), 0.93, **more).collect()}


def test_dense_groups_that_one_link_joins(spark):
    """Every list is full of closer links, so that of the two groups is in none."""
    turns = [*np.linspace(0, 5, 100), *np.linspace(5 + 21.54, 10 + 21.54, 100)]
    rows = [(i, [float(np.float32(np.cos(np.radians(t)))), float(np.float32(np.sin(np.radians(t))))], 0) for i, t in enumerate(turns)]
    want = brute(rows, 0.93)
    assert {c for _, c, _ in want.values()} == {0} and want[99][0] == want[100][0] == 100
    assert found(spark, rows) == want


def test_two_dense_groups_in_split_buckets(spark):
    turns = [*np.linspace(0, 5, 100), *np.linspace(5 + 21.54, 10 + 21.54, 100)]
    rows = [(i, [float(np.float32(np.cos(np.radians(t)))), float(np.float32(np.sin(np.radians(t))))], 0) for i, t in enumerate(turns)]
    assert found(spark, rows, block=16, k=3, rounds=1) == brute(rows, 0.93)


def pairs_apart(seed: int, many: int):
    """Single vectors, pairs of near copies and, with ``many``, a group whose links outnumber all others."""
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=16)
    rows = [hot + rng.normal(size=16) * 0.01 for _ in range(many)] + list(rng.normal(size=(500, 16)))
    for _ in range(40):
        center = rng.normal(size=16)
        rows += [center, center + rng.normal(size=16) * 0.3]
    return [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(rows)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_pairs_beside_a_large_group(spark, rounds):
    """Single pairs that are far below a thousandth of all links, with and without neighbours that lead to them."""
    rows = pairs_apart(8, 300)
    assert found(spark, rows, rounds=rounds, block=32) == brute(rows, 0.93)


def test_an_audit_finds_what_few_tables_lose(spark):
    """With one table and no rounds most pairs are lost; the audit sees it, and twice the tables are taken until none is."""
    rows = pairs_apart(9, 0)
    v = table(spark, rows)
    classes = v.mapInArrow(embedding_dup._unit_rows, "vec_id long, label long, raw binary, print binary").withColumnRenamed("vec_id", "cid")
    few = embedding_dup.linked(classes, len(rows), 0.93, 0, 1, 6, 0, 16, "<f8" if len(classes.first()["raw"]) == 128 else "<f4")
    n, lost = embedding_dup.missed(classes, few, 0.93, "<f4", queries=len(rows))
    want = brute(rows, 0.93)
    assert n == sum(links for links, _, _ in want.values()) and lost > 0
    assert found(spark, rows, block=16, miss=0.5) == want


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    for block in (embedding_dup.BLOCK, 8):
        assert differences(embedding_dup.near_duplicates(vectors, 0.93, block=block), embedding_dup.oracle(0.93), duck(sf)) == []
