"""Token counts against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from quarry.llm import token_counts
from tests.llm.helpers import clashing, documents, odd_texts, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark):
    rng = random.Random(6)
    chars = "ab é漢😀\n\t  ▁<s>0ſḰ ​"
    texts = odd_texts() + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<s>", "</s> <unk>", "a" * 3000, " " * 500, "▁▁ a▁b"] + [prose(rng, 90) for _ in range(30)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = token_counts.token_counts(clashing(documents(spark, texts)), PATH, limit=100).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 100), t[:80]
    assert len(rows) == len(texts)
    assert token_counts.token_counts(documents(spark, ["a"]).limit(0), PATH).count() == 0


def test_merge_counts_symbols_less_merges():
    c = token_counts.PieceCounter(PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for w in ("▁hello", "▁unbelievable", "▁zzzzqqq"):
        assert c.merge(w) == len(sp.encode(w.lstrip("▁")))


def test_unknown_model_is_an_error():
    with pytest.raises(Exception):  # noqa: B017
        token_counts.PieceCounter("/nowhere.model")
