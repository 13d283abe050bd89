"""Packing: exact round trips and how full sequences are."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm import packing
from tests.llm.helpers import clashing, documents, odd_texts, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs_texts, rows, capacity=1024):
    tok = Tokenizer.from_file(PATH)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(docs_texts)}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, ps in pieces.items():
        ps.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(ps):
            part = np.array(ids[doc][at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids[doc])
    for ps in sequences.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= capacity
    whole = packing.best_fit([r["length"] for r in rows], capacity)[2]
    return len(sequences), len(whole)


def test_round_trip(spark):
    rng = random.Random(4)
    texts = odd_texts() + ["<|endoftext|> inside", " lead", "x" * 5000] + [prose(rng, rng.randint(1, 700)) for _ in range(300)]
    rows = packing.pack(clashing(documents(spark, texts)), PATH).collect()
    n, on_one_machine = check(texts, rows)
    assert n <= 1.05 * on_one_machine + 1  # bins of 40 documents a task merge as wholes; see below for more of them


def test_sequences_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    n, tokens = packing.pack(docs, PATH).selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert n <= 1.01 * tokens / 1024 + 1


def test_small_windows_and_many_rounds(spark):
    """Windows that are flushed within a task, and rounds whose tasks cannot hold all underfull bins."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 900)) for _ in range(400)]
    docs = documents(spark, texts).repartition(7)
    n, on_one_machine = check(texts, packing.pack(docs, PATH, window=13, items_a_task=20).collect())
    assert n <= 1.08 * on_one_machine + 1
    n, _ = check(texts, packing.pack(docs, PATH, window=13).collect())
    assert n <= 1.08 * on_one_machine + 1  # bins of 13 pieces are merged as wholes


def test_empty_and_repeated(spark):
    docs = documents(spark, ["a", None])
    assert packing.pack(docs.limit(0), PATH).count() == 0
    rows = packing.pack(docs.union(docs), PATH).collect()
    assert len(rows) == 4 and len({r["sequence_id"] for r in rows}) == 1


def test_best_fit_is_near_the_bound():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1024) for _ in range(4000)]
    where, offset, fills = packing.best_fit(sizes, 1024)
    for b, fill in enumerate(fills):
        own = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if where[i] == b) if b < 50 else None
        assert fill <= 1024 and (own is None or sum(s for _, s in own) == fill)
    assert len(fills) <= 1.02 * sum(sizes) / 1024 + 1
