"""Masked pseudo-likelihood: a window network trained in numpy predicts every token from both of its sides.

Tokens are words and marks. All documents are counted, so every distinct token of the corpus has its own count. The network reads
three tokens on each side (an embedding for each place and token, summed, tanh) and predicts the token in two steps: its class
(softmax), and its slot in the class (softmax over that class's slots). Frequent tokens have a slot of their own; all others are hashed to
slots, and share a slot's probability by their counts. It is trained where the documents are: each task goes over every position
of all its documents, and what the tasks have learned is averaged by numbers of positions. The sum of conditional log-probabilities
scores a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Hashes, arrow_rows, discard, documents, materialize, mix64, text_batches

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Classes of tokens with slots of their own, classes of hashed ones, and slots of a class.
OWN, HASHED, SLOTS = 40, 24, 64
CLASSES = OWN + HASHED
#: Places of the window, and width of the network.
OFFSETS, HIDDEN = (-3, -2, -1, 1, 2, 3), 16
#: Tokens that a place of the window tells apart; rarer ones are known by their class. Row 0 is the edge of a document.
APART = 1000
CONTEXTS = 1 + APART + CLASSES
#: Tokens whose counts every task has; counts of all others are joined.
LISTED = 200_000
#: Every position of each document is trained on, in steps of ``STEP`` positions; what a task learns is rounded
#: to multiples of 2 ** -16, so that sums over tasks do not depend on their order.
STEP, RATE = 16_384, 0.03
#: Tokens that are scored at a time, and models that one task adds up.
CHUNK, ADDED = 16_384, 16
#: Bytes of texts or of ids that a task handles at a time, and ids that it counts at a time: what a task holds besides its model.
BYTES, COUNTED = 1_000_000, 1_000_000
#: Bytes of rows that Spark hands a task at a time: it holds several copies of these outside of its heap, and the task two more. Words
#: whose hashes a task remembers.
HANDED, REMEMBERED = 4_000_000, 100_000
_SHAPES = {"embed": (len(OFFSETS), CONTEXTS, HIDDEN), "bias": (HIDDEN,), "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "slot_w": (CLASSES, SLOTS, HIDDEN), "slot_b": (CLASSES, SLOTS)}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


class Places:
    """Where ids lie among sorted ones: by their top bits, then along the few that share these, as ids are hashes."""

    def __init__(self, ids: np.ndarray):
        self.bits, self.ids = len(ids).bit_length() + 1, np.append(ids, np.iinfo(np.int64).max)
        n = np.bincount(self._top(ids), minlength=1 << self.bits)
        self.first, self.most = np.cumsum(n) - n, int(n.max())

    def _top(self, ids: np.ndarray) -> np.ndarray:
        return (ids >> (64 - self.bits)) + (1 << (self.bits - 1))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and which ids are there."""
        at = self.first[self._top(ids)]
        for _ in range(self.most - 1):
            at += self.ids[at] < ids
        return at, (self.ids[at] == ids) & (at < len(self.ids) - 1)


@dataclass
class Vocabulary:
    """Own tokens sorted by id, with their code (class * SLOTS + slot) and rank; counts of listed tokens sorted by id; mass of codes."""

    own: np.ndarray
    code: np.ndarray
    rank: np.ndarray
    listed: np.ndarray
    count: np.ndarray
    mass: np.ndarray

    @cached_property
    def _own(self) -> Places:
        return Places(self.own)

    @cached_property
    def _listed(self) -> Places:
        return Places(self.listed)

    def codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, rows of the window's embeddings, and which tokens are hashed."""
        at, known = self._own.find(ids)
        code = hashed_code(ids)
        code[known] = self.code[at[known]]
        row = 1 + APART + code // SLOTS
        frequent = known.copy()
        frequent[known] = self.rank[at[known]] < APART
        row[frequent] = 1 + self.rank[at[frequent]]
        return code, row, ~known

    def share(self, ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log of the part of their slot that hashed tokens have, and which of them are not listed (for those: of a count of one)."""
        at, found = self._listed.find(ids)
        n = np.ones(len(ids))
        n[found] = self.count[at[found]]
        return np.log(n / (self.mass[code] + 1)), ~found


def hashed_code(ids: np.ndarray) -> np.ndarray:
    h = mix64(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(40)) % np.uint64(HASHED * SLOTS)).astype(np.int64) + OWN * SLOTS


def own_codes(counts: np.ndarray) -> np.ndarray:
    """Codes of tokens by falling count: classes of about equal mass with at most SLOTS tokens; as many as OWN classes hold."""
    out, total = [], float(counts[: OWN * SLOTS].sum())
    cls = slot = 0
    mass = 0.0
    for n in counts[: OWN * SLOTS].tolist():
        if slot == SLOTS or (mass >= total / OWN and cls < OWN - 1):
            cls, slot, mass = cls + 1, 0, 0.0
        if cls == OWN:
            break
        out.append(cls * SLOTS + slot)
        slot, mass = slot + 1, mass + n
    return np.array(out, dtype=np.int64)


def empty_model(mass: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """A network that predicts every token by its count alone."""
    rng = np.random.default_rng(seed)
    out = {k: np.zeros(s, dtype=np.float32) for k, s in _SHAPES.items()}
    out["embed"] = rng.normal(0, 0.3, _SHAPES["embed"]).astype(np.float32)
    slots = mass.reshape(CLASSES, SLOTS) + 1e-3
    out["slot_b"] = np.log(slots / slots.sum(1, keepdims=True)).astype(np.float32)
    out["class_b"] = np.log(slots.sum(1) / slots.sum()).astype(np.float32)
    return out


def windows(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Embedding rows of the six neighbours of positions ``at``, whose documents lie from ``starts`` to ``ends``."""
    out = np.zeros((len(OFFSETS), len(at)), dtype=np.int64)
    for k, d in enumerate(OFFSETS):
        there = at + d
        inside = (there >= starts) & (there < ends)
        out[k, inside] = rows[there[inside]]
    return out


def _hidden(m: dict[str, np.ndarray], window: np.ndarray) -> np.ndarray:
    h = np.take(m["embed"][0], window[0], axis=0)
    there = np.empty_like(h)
    for k in range(1, len(OFFSETS)):
        h += np.take(m["embed"][k], window[k], axis=0, out=there, mode="clip")
    h += m["bias"]
    return np.tanh(h, out=h)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by class, and where each class begins; small numbers are sorted by counting."""
    return np.argsort(cls.astype(np.uint8), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])


def _present(cuts: np.ndarray) -> list[tuple[int, slice]]:
    return [(c, slice(cuts[c], cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts)).tolist()]


def _logits(m: dict[str, np.ndarray], ones: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of classes, and of the slots of each position's class, less the largest: a column for each position, as columns are summed
    fast. ``ones`` has the hidden values and a one for the biases, for positions sorted by class."""
    z = np.vstack([m["class_w"], m["class_b"]]).T @ ones.T
    slot = np.concatenate([m["slot_w"], m["slot_b"][:, :, None]], 2)
    s = np.empty((SLOTS, len(ones)), dtype=z.dtype)
    for c, at in _present(cuts):
        np.matmul(slot[c], ones[at].T, out=s[:, at])
    z -= z.max(0)
    s -= s.max(0)
    return z, s


def _with_one(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones_like(h[:, :1])], 1)


def log_probs(m: dict[str, np.ndarray], window: np.ndarray, code: np.ndarray) -> np.ndarray:
    """log P(class | window) + log P(slot | class, window)."""
    order, cuts = _by_class(code // SLOTS)
    code, out = code[order], np.zeros(len(code))
    for x, own in zip(_logits(m, _with_one(_hidden(m, window[:, order])), cuts), divmod(code, SLOTS), strict=True):
        out[order] += x[own, np.arange(len(code))]
        out[order] -= np.log(np.exp(x, out=x).sum(0))
    return out


def gradients(m: dict[str, np.ndarray], window: np.ndarray, code: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean of -log_probs."""
    order, cuts = _by_class(code // SLOTS)
    window, code = window[:, order], code[order]
    h = _hidden(m, window)
    ones = _with_one(h)
    z, s = _logits(m, ones, cuts)
    for x, own in zip((z, s), divmod(code, SLOTS), strict=True):
        np.exp(x, out=x)
        x /= x.sum(0)
        x[own, np.arange(len(code))] -= 1
    by_class, by_slot = (z @ ones).T, np.zeros((CLASSES, SLOTS, HIDDEN + 1), dtype=h.dtype)
    dh = z.T @ m["class_w"].T
    for c, at in _present(cuts):
        by_slot[c] = s[:, at] @ ones[at]
        dh[at] += s[:, at].T @ m["slot_w"][c]
    dh *= 1 - h * h
    embed = np.zeros_like(m["embed"])
    for k in range(len(OFFSETS)):
        order = np.argsort(window[k].astype(np.int16), kind="stable")
        row = window[k][order]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        embed[k][row[begin]] = np.add.reduceat(dh[order], begin, axis=0)
    g = {"embed": embed, "bias": dh.sum(0), "class_w": by_class[:-1], "class_b": by_class[-1], "slot_w": by_slot[:, :, :-1], "slot_b": by_slot[:, :, -1]}
    return {k: v / len(code) for k, v in g.items()}


class Trainer:
    """Adam steps over windows and codes."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.m = {k: v.copy() for k, v in model.items()}
        self.first = {k: np.zeros_like(v) for k, v in model.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.items()}
        self.steps = self.positions = 0

    def step(self, window: np.ndarray, code: np.ndarray) -> None:
        g = gradients(self.m, window, code)
        self.steps += 1
        self.positions += len(code)
        rate = RATE * min(1.0, self.steps / 10) / np.sqrt(1 + self.steps / 200)
        for k, v in self.m.items():
            self.first[k] += 0.1 * (g[k] - self.first[k])
            self.second[k] += 0.01 * (g[k] * g[k] - self.second[k])
            v -= rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-7)


def _flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in _SHAPES])


def _unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


@dataclass
class Model:
    words: Vocabulary
    net: dict[str, np.ndarray]


def _id_rows(batches: Iterator) -> Iterator:
    """(doc_id, ids): the 64-bit ids of a document's tokens."""
    import pyarrow as pa

    hashes = Hashes(REMEMBERED)
    for doc_ids, texts in text_batches(batches, "doc_id", "text", most=BYTES):
        lists = [tokens(t) for t in texts]
        flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=sum(map(len, lists)))
        ends = np.cumsum([len(x) for x in lists])
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([p.tobytes() for p in np.split(flat, ends[:-1])], pa.binary())], ["doc_id", "ids"])


def _laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents one after another, and where each document begins and, last, where all end."""
    return np.frombuffer(b"".join(parts), dtype=np.int64), np.concatenate([[0], np.cumsum([len(p) // 8 for p in parts])]).astype(np.int64)


def _count_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held, size = [], 0

    def out():
        ids, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["word", "n"])

    for (parts,) in text_batches(batches, "ids", text="ids", most=BYTES):
        held.append(_laid(parts)[0])
        size += len(held[-1])
        if size >= COUNTED:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _code_rows(own: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mass = np.zeros(CLASSES * SLOTS, dtype=np.int64)
        for ids, ns in arrow_rows(batches, "word", "n"):
            ids, ns = np.array(ids, dtype=np.int64), np.array(ns, dtype=np.int64)
            rest = ~np.isin(ids, own)
            np.add.at(mass, hashed_code(ids[rest]), ns[rest])
        at = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], ["code", "n"])

    return run


def learn(docs: DataFrame, ids: DataFrame | None = None, counts: DataFrame | None = None) -> Model:
    """Counts all tokens of ``docs(doc_id, text)`` and trains the network on every position of all documents."""
    sc = docs.sparkSession.sparkContext
    own_tables = []
    if ids is None:
        ids = materialize(documents(docs).mapInArrow(_id_rows, "doc_id long, ids binary"), "lm", HANDED)
        counts = materialize(ids.select("ids").mapInArrow(_count_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm", HANDED)
        own_tables = [ids, counts]
    top = counts.orderBy(F.desc("n"), "word").limit(LISTED).toPandas()
    word, n = top["word"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)
    code = own_codes(n)
    own, by_id = word[: len(code)], np.argsort(word[: len(code)])
    mass = np.zeros(CLASSES * SLOTS)
    mass[code] = n[: len(code)]
    for r in counts.mapInArrow(_code_rows(own), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        mass[r["code"]] += r["n"]
    order = np.argsort(word)
    words = Vocabulary(own[by_id], code[by_id], by_id.astype(np.int64), word[order], n[order].astype(np.float64), mass)
    start = sc.broadcast((words, empty_model(mass)))

    def train(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, first = start.value
        trainer, held, size = Trainer(first), [], 0

        def step() -> None:
            trainer.step(np.concatenate([w for w, _ in held], axis=1), np.concatenate([c for _, c in held]))
            held.clear()

        for (parts,) in text_batches(batches, "ids", text="ids", most=BYTES):
            flat, ends = _laid(parts)
            code_, rows, _ = known.codes(flat)
            doc = np.repeat(np.arange(len(parts)), np.diff(ends))
            begin = 0
            while begin < len(flat):
                at = np.arange(begin, min(begin + STEP - size, len(flat)))
                held.append((windows(rows, ends[doc[at]], ends[doc[at] + 1], at), code_[at]))
                begin, size = begin + len(at), size + len(at)
                if size == STEP:
                    step()
                    size = 0
        if held:
            step()
        if trainer.positions:
            fixed = np.round(_flat(trainer.m) * 65536).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([trainer.positions], pa.int64()), pa.array([fixed.tobytes()], pa.binary()), pa.array([True])], ["n", "sums", "single"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals: dict[int, list] = {}
        for groups, ns, parts, singles in arrow_rows(batches, "g", "n", "sums", "single"):
            for g, k, part, single in zip(groups, ns, parts, singles, strict=True):
                x = np.frombuffer(part, dtype=np.int32).astype(np.int64) * k if single else np.frombuffer(part, dtype=np.int64)
                own = totals.setdefault(g, [0, 0])
                own[0], own[1] = own[0] + k, own[1] + x
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in totals.values()], pa.int64()), pa.array([t[1].tobytes() for t in totals.values()], pa.binary()), pa.array([False] * len(totals))], ["n", "sums", "single"])

    schema = "n long, sums binary, single boolean"
    learned = materialize(ids.mapInArrow(train, schema), "lm", HANDED)
    left = learned.count()
    while left > 1:  # a task adds up a few models, so none, nor the driver, gets all of them
        left = -(-left // ADDED)
        dealt = learned.withColumn("g", F.pmod(F.xxhash64("sums"), F.lit(left))).repartition(left, "g")
        after = materialize(dealt.mapInArrow(add, schema), "lm", HANDED)
        discard(learned)
        learned = after
    rows = learned.collect()
    net = start.value[1]
    if rows:
        r = rows[0]
        net = _unflat(np.frombuffer(r["sums"], dtype=np.int32) / 65536 if r["single"] else np.frombuffer(r["sums"], dtype=np.int64) / (65536 * r["n"]))
    for df in (learned, *own_tables):
        discard(df)
    return Model(words, net)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob for every row of ``docs(doc_id, text)``.

    log_prob is the sum over all tokens of log P(token | three tokens on each side); mean_log_prob is null for texts without tokens (null,
    empty, blank: n_tokens 0, log_prob 0). Repeated rows count, and are scored as they are; a null doc_id is kept; further columns
    are ignored; an empty table gives no rows. Equal counts are ordered by token id, so ties are broken alike everywhere.

    Whole texts are read once and their token ids (eight bytes each) written; all tokens are counted, summed within tasks before the
    shuffle; the network has a fixed size (under 1 MB) and learns from every position. Tokens beyond the 200,000 most frequent
    ones are joined with their counts by (row, token), once a document. The driver gets these 200,000 counts and one network.
    """
    spark = docs.sparkSession
    ids = materialize(documents(docs).mapInArrow(_id_rows, "doc_id long, ids binary").withColumn("row", F.monotonically_increasing_id()), "lm", HANDED)
    counts = materialize(ids.select("ids").mapInArrow(_count_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm", HANDED)
    model = spark.sparkContext.broadcast(learn(docs, ids.select("doc_id", "ids"), counts))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, net = model.value.words, model.value.net
        for row_ids, doc_ids, parts in text_batches(batches, "row", "doc_id", "ids", text="ids", most=BYTES):
            flat, ends = _laid(parts)
            code, rows, hashed = words.codes(flat)
            doc = np.repeat(np.arange(len(parts)), np.diff(ends))
            each = np.zeros(len(flat))
            for k in range(0, len(flat), CHUNK):
                at = np.arange(k, min(k + CHUNK, len(flat)))
                each[at] = log_probs(net, windows(rows, ends[doc[at]], ends[doc[at] + 1], at), code[at])
            at = np.flatnonzero(hashed)
            share, unlisted = words.share(flat[at], code[at])
            each[at] += share
            total = np.bincount(doc, weights=each, minlength=len(parts))[: len(parts)] if len(flat) else np.zeros(len(parts))
            r = np.array(row_ids, dtype=np.int64)
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends)), pa.array(total), none(len(r), pa.int64()), none(len(r), pa.int64())], ["row", "doc_id", "n_tokens", "log_prob", "word", "times"])
            if len(rare := at[unlisted]):
                kinds, number = np.unique(flat[rare], return_inverse=True)
                pair, times = np.unique(doc[rare] * len(kinds) + number, return_counts=True)
                m = len(pair)
                yield pa.RecordBatch.from_arrays([pa.array(r[pair // len(kinds)]), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), pa.array(kinds[pair % len(kinds)]), pa.array(times.astype(np.int64))], ["row", "doc_id", "n_tokens", "log_prob", "word", "times"])

    scored = materialize(ids.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double, word long, times long"), "lm", HANDED)
    discard(ids)
    rare = scored.where("word is not null").join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    out = scored.where("word is null").join(rare, "row", "left")
    total = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
