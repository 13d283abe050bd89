"""Shards: counts, mixture, slots."""

import zlib
from collections import Counter

import pytest

from quarry.llm import sharding
from tests.compare import differences, duck
from tests.llm.helpers import clashing, documents, odd_texts


@pytest.mark.parametrize("slice_rows, slices_a_run", [(sharding.SLICE_ROWS, sharding.SLICES_A_RUN), (7, 4), (1, 1)])
def test_shards(spark, slice_rows, slices_a_run):
    texts = odd_texts() + [f"text {i}" for i in range(700)]
    docs = documents(spark, texts)
    rows = sharding.proportional_shards(clashing(docs), 16, slice_rows=slice_rows, slices_a_run=slices_a_run).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    source = {i: f"s{i % 3}" if i % 4 else None for i in range(len(texts))}
    whole = Counter(source.values())
    for s in sizes:
        own = Counter(source[r["doc_id"]] for r in rows if r["shard"] == s)
        assert all(abs(own[x] - whole[x] / 16) <= 2 for x in whole)


def test_repeated_empty_and_same_again(spark):
    docs = documents(spark, ["a", "b", None])
    assert sharding.proportional_shards(docs.limit(0)).count() == 0
    twice = sharding.proportional_shards(docs.union(docs), 4).collect()
    assert len(twice) == 6 and max(Counter(r["shard"] for r in twice).values()) <= 2
    again = [sorted(map(str, sharding.proportional_shards(docs, 4).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_ties_of_one_doc_id_go_by_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "s") for i in range(50)] + [(None, None, None)] * 3, "doc_id long, text string, source string")
    runs = [sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in sharding.proportional_shards(docs.repartition(n), 4, slice_rows=5).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 53


@pytest.mark.parametrize("slice_rows", [sharding.SLICE_ROWS, 7])
def test_sql(spark, slice_rows):
    sf = "/root/testdata/sf0.001"
    got = sharding.proportional_shards(spark.read.parquet(f"{sf}/documents.parquet"), 16, slice_rows=slice_rows)
    assert differences(got, sharding.oracle(16), duck(sf)) == []
