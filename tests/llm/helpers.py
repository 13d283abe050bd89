"""Small document tables with the cases that every operator must stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_VOCABULARY = "the of and river stone light window garden winter summer house road letter music paper water bread horse silver copper market engine signal harbor mountain valley forest castle bridge teacher doctor sailor farmer".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(_VOCABULARY) + (rng.choice(_VOCABULARY) if rng.random() < 0.3 else "") for _ in range(n))


def documents(spark, texts, **more):
    """Rows with ids from 0; texts may be null."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = prose(rng, 80)
    return [base, base, None, "", "  \n\t ", "one", "a b c d", base + " end", prose(rng, 30_000), "é ü 漢字 😀 " * 20, prose(rng, 60), prose(rng, 60), "\x00 zero \x0b vertical", base.upper()]


def clashing(docs):
    """The same rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "component", "print", "rank", "score", "found", "bin", "t_", "base_", "row", "w_hex", "s_r", "__bad", "mixed", "y", "f", "label", "hub", "n", "stratum"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs
