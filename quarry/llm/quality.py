"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model fitted to them by dual
coordinate descent (naive Bayes support vectors); margins become probabilities by a logistic fit on held-out folds.

Indicators are hashed word uni- and bigrams, and uni- and bigrams of token kinds (letter case, digits, the mark itself,
repeats of the word before) at levels of their share of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Hashes, discard, documents, materialize, mix64, text_batches

BITS = 18
KINDS, LEVELS = 40, 9
#: Kinds: 0 lower word, 1 capitalised, 2 upper, 3 digits, 4 mixed, 5 repeat of the word before, 6 to 39 marks.
REPEAT = 5
SIZE = (1 << BITS) + (KINDS + KINDS * KINDS) * LEVELS
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Kinds(dict):
    def __init__(self, hashes: Hashes):
        self.hashes = hashes

    def __missing__(self, t: str) -> int:
        if not (t[0].isalnum() or t[0] == "_"):
            k = 6 + self.hashes[t[:3]] % (KINDS - 6)
        elif t.isdigit():
            k = 3
        elif t.islower():
            k = 0
        elif t.isupper() and len(t) > 1:
            k = 2
        elif t.istitle():
            k = 1
        else:
            k = 4
        if len(self) > 400_000:
            self.clear()
        self[t] = k
        return k


def features(texts: list[str], hashes: Hashes, kinds: _Kinds) -> list[np.ndarray]:
    """Sorted distinct indicators of each text."""
    lists = [_TOKEN.findall(t) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    n = int(counts.sum())
    ids = np.fromiter((hashes[t] for x in lists for t in x), dtype=np.uint64, count=n)
    kind = np.fromiter((kinds[t] for x in lists for t in x), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(texts)), counts)
    same = np.zeros(n, dtype=bool)
    same[1:] = doc[1:] == doc[:-1]
    kind[1:][same[1:] & (ids[1:] == ids[:-1])] = REPEAT
    pair = np.flatnonzero(same)
    one = (mix64(ids) >> np.uint64(64 - BITS)).astype(np.int64)
    two = (mix64(ids[pair - 1] * np.uint64(0x9E3779B97F4A7C15) + ids[pair]) >> np.uint64(64 - BITS)).astype(np.int64)
    width = KINDS + KINDS * KINDS
    share = np.bincount(doc * width + kind, minlength=len(texts) * width) + np.bincount(doc[pair] * width + KINDS + kind[pair - 1] * KINDS + kind[pair], minlength=len(texts) * width)
    at = np.flatnonzero(share)
    level = np.clip(-np.floor(np.log2(share[at] / counts[at // width])), 0, LEVELS - 1).astype(np.int64)
    where = np.concatenate([doc, doc[pair], at // width])
    which = np.concatenate([one, two, (1 << BITS) + (at % width) * LEVELS + level])
    code = np.unique(where * SIZE + which)
    cuts = np.searchsorted(code, np.arange(len(texts) + 1) * SIZE)
    return [(code[cuts[k] : cuts[k + 1]] % SIZE).astype(np.int32) for k in range(len(texts))]


@dataclass
class Model:
    weights: np.ndarray  # of indicators, already scaled by the ratios
    ratios: np.ndarray
    slope: float
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows))
        for k, f in enumerate(rows):
            if len(f):
                out[k] = self.weights[f].sum() / (np.sqrt((self.ratios[f] ** 2).sum()) + 1e-9)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def _linear(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    pos, neg = np.ones(SIZE), np.ones(SIZE)
    for f, label in zip(rows, y, strict=True):
        (pos if label else neg)[f] += 1
    ratios = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratios[(pos + neg) < 4] = 0  # seen once: says nothing of other texts
    vectors = [ratios[f] / (np.sqrt((ratios[f] ** 2).sum()) + 1e-9) for f in rows]
    square = [float((v * v).sum()) for v in vectors]
    sign = np.where(y > 0, 1.0, -1.0)
    caps = np.where(y > 0, cost, cost * min(10.0, max(1.0, (y > 0).sum() / max(1, (y <= 0).sum()))))
    w, alpha, rng = np.zeros(SIZE), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            step = np.clip(alpha[i] - (sign[i] * (w[rows[i]] @ vectors[i]) - 1) / square[i], 0, caps[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * sign[i] * vectors[i]
    return w * ratios, ratios


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 8, folds: int = 3, seed: int = 5) -> Model:
    """Hinge-loss model of 0/1 labels; without both labels a constant."""
    y = np.asarray(y)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 1.0, 3.0 if len(y) and y[0] else -3.0 if len(y) else 0.0)
    part, margins = np.random.default_rng(seed).permutation(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        inside = [r for r, p in zip(rows, part, strict=True) if p != k]
        m = Model(*_linear(inside, y[part != k], cost, epochs, seed), 1.0, 0.0)
        margins[part == k] = m.margins([r for r, p in zip(rows, part, strict=True) if p == k])
    slope, shift = 1.0, 0.0
    for _ in range(60):  # Newton steps of the logistic fit, a little damped
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        g = np.array([((p - y) * margins).sum() + 1e-3 * slope, (p - y).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        d = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        slope, shift = slope - np.clip(d[0], -2, 2), shift - np.clip(d[1], -2, 2)
    return Model(*_linear(rows, y, cost, epochs, seed), float(slope), float(shift))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 5000, most_indicators: int = 20_000_000) -> Model:
    """Fits on labelled rows outside of fold 0: at most ``most`` doc_ids, by a hash of doc_id, and of these as many as have
    ``most_indicators`` together (80 MB) are read to the driver as indicators.

    Null ids and labels are left out; of repeated label rows the largest label holds, of repeated documents the least text;
    further columns are ignored. Without labelled documents, or with one label only, the model is a constant.
    """
    chosen = labels.where(fold(F.col("doc_id")) != 0).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = Hashes()
        kinds = _Kinds(hashes)
        for ids, texts, ys in text_batches(batches, "doc_id", "text", "y"):
            rows = features(texts, hashes, kinds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f.tobytes() for f in rows], pa.binary()), pa.array(ys, pa.int32()), pa.array([len(f) for f in rows], pa.int64())], ["doc_id", "f", "y", "n"])

    texts = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = materialize(texts.mapInArrow(run, "doc_id long, f binary, y int, n long").withColumn("place", F.xxhash64("doc_id")), "labelled")
    sizes = rows.select("place", "doc_id", "n").toPandas().sort_values(["place", "doc_id"], kind="stable")
    within = sizes[sizes["n"].cumsum() <= most_indicators]
    got = rows.where(F.col("place") <= (int(within["place"].iloc[-1]) if len(within) else -(1 << 63))).toPandas().sort_values("doc_id", kind="stable")
    discard(rows)
    return fit([np.frombuffer(b, dtype=np.int32) for b in got["f"]], got["y"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``: a narrow map over whole texts.

    Null and empty texts get the score of a text without indicators; a null doc_id is not held out; repeated rows are scored
    alike; an empty table gives no rows; further columns are ignored. The model is about 4 MB whatever the input, and goes to the executors once.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.ratios.astype(np.float32), model.slope, model.shift))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, m = Hashes(), Model(*sent.value)
        kinds = _Kinds(hashes)
        for ids, texts in text_batches(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(m.scores(features(texts, hashes, kinds)), pa.float64())], ["doc_id", "score"])

    out = documents(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject.

    A null or empty text is kept or not by the score of a text without indicators; rows with a null doc_id are scored like all
    others; repeated rows are kept or go together; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.ratios.astype(np.float32), model.slope, model.shift))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, m = Hashes(), Model(*sent.value)
        kinds = _Kinds(hashes)
        for b in batches:
            good = [m.scores(features(texts, hashes, kinds)) >= threshold for (texts,) in text_batches([b], "text")]
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
