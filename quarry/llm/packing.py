"""Best-fit packing by hierarchical residual packing.

Partitions pack their own pieces best-fit and emit bins that are (nearly) full; the underfull bins become items, are
merged in fewer and fewer partitions, and are packed best-fit again, up to one last round.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, discard, documents, materialize, text_batches

#: Pieces that one task holds at a time, and underfull bins that one task of a later round gets.
WINDOW, ITEMS = 60_000, 100_000
#: Partitions that one task of the next round takes over, and rounds at most (bins get numbers of 5 bits for the round).
FAN_IN, ROUNDS = 8, 30


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> uint32 ids, as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where merge order equals id order, as in public byte-level vocabularies, ``tiktoken`` yields the same ids some four
    times faster; otherwise the library itself is used.
    """
    spec = json.load(open(path, encoding="utf-8"))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    made = [vocab.get(a + b, -1) for a, b in merges]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    if plain and made == sorted(made) and made and made[0] >= 0 and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
        enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: np.array(enc.encode(text, allowed_special="all"), dtype="<u4")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin of each item, its offset there, and the bins' fills. Sizes lie in 1 to capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        above = mask >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        if left := space - size:
            by_space[left].append(b)
            mask |= 1 << left
    return where, offset, fills


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, slack: int = 2, window: int = WINDOW, items_a_task: int = ITEMS) -> DataFrame:
    """Packs every row of ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; longer ones are cut so that only the first piece may be shorter than the
    capacity. Returns doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), sequence_id, offset.
    Null and empty texts are the end id alone; repeated rows are packed again; an empty table gives no rows; further
    columns are ignored. Pieces of one length are ordered arbitrarily among themselves. Only rows without texts are shuffled; an
    underfull bin (more than ``slack`` tokens left) is a (bin, fill) row in later rounds. Rounds go on until one task has had all
    underfull bins at once; where these are too many for a task (over ``items_a_task``), each round deals them anew, until a round
    merges fewer than one in a thousand.
    """
    spark = docs.sparkSession

    def local(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, base, made = encoder(tokenizer_path), TaskContext.get().partitionId() << 36, 0
        tail = np.array([end_id], dtype="<u4")
        held: list[tuple] = []

        def flush() -> Iterator:
            nonlocal held, made
            where, offset, fills = best_fit([h[3] for h in held], capacity)
            cols = list(zip(*held, strict=True))
            bins = np.array(where, dtype=np.int64)
            filled = np.array(fills, dtype=np.int32)[bins]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(bins + (base + made)), pa.array(offset, pa.int64()), pa.array(filled)], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"])
            made += len(fills)
            held = []

        for ids, texts in text_batches(batches, "doc_id", "text"):
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.concatenate([encode(text), tail])
                cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    held.append((doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
                if len(held) >= window:
                    yield from flush()
        if held:
            yield from flush()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill int"
    pieces = materialize(documents(docs).mapInArrow(local, schema), "pack")
    open_bins = pieces.where(F.col("fill") < capacity - slack).groupBy("bin").agg(F.first("fill").alias("fill"))
    moves = materialize(open_bins.select("bin", F.col("bin").alias("at"), F.lit(0).cast("long").alias("base"), "fill"), "pack")
    parts = pieces.rdd.getNumPartitions()
    level, items = 0, moves.count()
    while items > 1 and level < ROUNDS:
        level += 1
        parts = max(-(-parts // FAN_IN), -(-items // items_a_task))
        frontier = moves.where(F.col("fill") < capacity - slack).groupBy("at").agg(F.first("fill").alias("fill"))
        dealt = frontier.repartition(parts, F.xxhash64("at", F.lit(level))).sortWithinPartitions("at")
        step = materialize(dealt.mapInArrow(_merge(capacity, level, 4 * items_a_task), "item long, parent long, shift long, total int"), "pack")
        new = moves.join(step, moves["at"] == step["item"], "left").select("bin", F.coalesce("parent", "at").alias("at"), (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"), F.coalesce("total", "fill").alias("fill"))
        new = materialize(new, "pack")
        discard(moves)
        discard(step)
        moves = new
        left = moves.where(F.col("fill") < capacity - slack).select("at").distinct().count()
        if parts == 1 or (parts == -(-items // items_a_task) and left > 0.999 * items):
            break
        items = left
    out = pieces.join(moves.select("bin", "at", "base"), "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("at", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"))


def _merge(capacity: int, level: int, most: int):
    """Packs underfull bins as items; new bins get numbers that no other round or partition gives."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base, made = (level << 58) | TaskContext.get().partitionId() << 36, 0
        held: list[tuple[int, int]] = []

        def flush() -> Iterator:
            nonlocal held, made
            where, offset, fills = best_fit([f for _, f in held], capacity)
            bins = np.array(where, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array(bins + (base + made)), pa.array(offset, pa.int64()), pa.array(np.array(fills, dtype=np.int32)[bins])], ["item", "parent", "shift", "total"])
            made += len(fills)
            held = []

        for bins, fills in arrow_rows(batches, "at", "fill"):
            held += zip(bins, fills, strict=True)
            if len(held) >= most:
                yield from flush()
        if held:
            yield from flush()

    return run
