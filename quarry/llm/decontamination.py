"""Benchmark decontamination: documents that hold a passage within a small edit distance, over words, of a benchmark item.

A seeded random walk over a word sequence (repeat or advance, by a bit of the hash of step and word) embeds edit distance in
Hamming distance: two walks that read the same words stay together, and after an edit soon meet again. Walks start at anchors along
each item, and at each place of a document where an item may lie; a few steps of a walk are sampled as a hash key, and this is
repeated until planted edits of every shape are found again at the target recall. Keys that an item shares lead to exact edit
verification. Places with too few of the benchmark's word pairs around them cannot lie within the distance (q-gram bound) and
are not embedded. Items that allow no edit are looked up as whole runs of words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, mix64, text_batches

_WORD = re.compile(r"\w+")
#: Bytes of benchmark text of one pass over the documents (about thirty times as much in memory); more are taken in blocks.
BLOCK_BYTES = 4_000_000
#: Words between anchors, repetitions to begin with, steps between samples, steps over which the first sample is drawn.
ANCHOR, TABLES, GAP, REACH = 4, 24, 2, 16
#: Starts that are embedded at a time, and items of a class that planted edits are tried on.
STARTS, TRIED = 4096, 48
#: Where planted edits lie in an item, as shares of its length, and which they are (0 replaced, 1 put in, 2 taken out).
SHAPES = {"spread": (0, 1, (0, 1, 2)), "first half": (0, 0.5, (0, 1, 2)), "last half": (0.5, 1, (0, 1, 2)), "middle": (0.25, 0.75, (0, 1, 2)), "insertions": (0, 1, (1,)), "deletions": (0, 1, (2,)), "even": (0, 1, ())}
_PAIR_BITS = 22


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def walk(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: np.ndarray, with_ends: bool = False):
    """Hash keys, one row for each row of ``steps`` (a repetition: its own walk, and the steps that it samples), one column for
    each start, of the word ids that the walks read at those steps; a word at or after ``ends`` is 0. With ``with_ends`` also
    whether the walk was still before its end at the last sample."""
    rounds = np.arange(len(steps), dtype=np.uint64)[:, None]
    at = np.repeat(starts[None, :], len(steps), axis=0)
    key = np.repeat(mix64(rounds + np.uint64(77)), len(starts), axis=1)
    inside = np.ones(key.shape, dtype=bool)
    for j in range(int(steps.max()) + 1):
        live = at < ends
        w = np.where(live, ids[np.minimum(at, len(ids) - 1)], 0).astype(np.uint64)
        sampled = np.flatnonzero((steps == j).any(1))
        if len(sampled):
            key[sampled] = mix64(key[sampled] * np.uint64(0x9E3779B97F4A7C15) + w[sampled])
            inside[sampled] &= live[sampled]
        bit = mix64(w * np.uint64(0xD6E8FEB86659FD93) + (rounds * np.uint64(100_003) + np.uint64(j))) >> np.uint64(63)
        at += bit.astype(np.int64)
    return (key, inside) if with_ends else key


def masks(item: np.ndarray) -> dict[int, int]:
    """For each word id the bits of its places in ``item``."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def nearest(item: np.ndarray, text: np.ndarray, places: dict[int, int] | None = None) -> tuple[int, int]:
    """The least edit distance of ``item`` to any run of ``text``, and the end of the first best run: a column of the distance
    matrix is two bit vectors of its differences, so a word of the text costs a few operations on whole numbers."""
    n = len(item)
    places = masks(item) if places is None else places
    whole, top = (1 << n) - 1, 1 << n - 1
    up, down, score = whole, 0, n
    best, end = n, 0
    for j, w in enumerate(text.tolist(), 1):
        x = places.get(w, 0) | down
        same = ((up + (x & up)) ^ up) | x
        falls = up & same
        rises = down | whole & ~(up | same)
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
        x = rises << 1 & whole
        down = x & same
        up = falls << 1 & whole | whole & ~(x | same)
        if score < best:
            best, end = score, j
    return best, end


def planted(ids: np.ndarray, edits: int, shape: str, rng) -> np.ndarray:
    """``ids`` after ``edits`` word edits of a shape of ``SHAPES``; words that are put in are 0."""
    out, n = ids.tolist(), len(ids)
    first, last, kinds = SHAPES[shape]
    for e in range(edits):
        if not kinds:
            out[int((e + 0.5) * n / edits)] = 0
            continue
        p = min(int(rng.integers(int(first * n), max(int(first * n) + 1, int(last * n)))), len(out) - 1)
        what = kinds[int(rng.integers(0, len(kinds)))]
        if what == 0:
            out[p] = 0
        elif what == 1:
            out.insert(p, 0)
        elif len(out) > 1:
            out.pop(p)
    return np.array(out, dtype=np.int64)


class Index:
    """Hash tables of a block of items: whole runs for items that allow no edit, walks for all others."""

    def __init__(self, items: list[tuple[int, str]], share: float, recall: float, seed: int = 1):
        self.share = share
        self.vocabulary: dict[str, int] = {}
        self.runs: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ws = words(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64)
            if len(ws) and not self.far(len(ws)):
                self.runs[len(ws)][tuple(ids.tolist())].append(item_id)
            elif ws:
                self.items.append((item_id, ids))
        self.runs = {n: dict(r) for n, r in self.runs.items()}
        self.run_keys = {n: np.unique(_run_keys(np.array(list(r), dtype=np.int64))) for n, r in self.runs.items()}
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        for _, ids in self.items:
            self.pairs[self.pair(ids[:-1], ids[1:])] = True
        codes = [mix64((ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)) + np.array([k], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k, (_, ids) in enumerate(self.items)]
        self.own_pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *codes]))  # hashes of item and word pair
        self.classes: list[tuple[int, int]] = []  # (words around a start, word pairs that must be there)
        groups: dict[int, list[int]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            groups[int(np.log(len(ids)) / np.log(1.25))].append(k)
        for own in groups.values():
            lengths = [len(self.items[k][1]) for k in own]
            # the weakest bound that holds for any length of the class
            self.classes.append((max(lengths) + self.far(max(lengths)), min(n - 1 - 2 * self.far(n) for n in range(min(lengths), max(lengths) + 1))))
        self.places = [masks(ids) for _, ids in self.items]
        self.lengths = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        self.walks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        by_samples: dict[int, list[int]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            by_samples[self.samples(len(ids))].append(k)
        for samples, own in sorted(by_samples.items()):
            tried = self._tried(own, groups)
            tables, anchor = TABLES, ANCHOR
            while True:
                rng = np.random.default_rng(seed)
                first = rng.integers(0, REACH, tables)
                steps = first[:, None] + GAP * np.arange(samples)[None, :]
                if anchor == 1 and tables >= 1024 or self.worst(tried, steps, anchor, rng) >= recall:
                    break
                tables, anchor = min(1024, 2 * tables), max(1, anchor // 2)  # in the end, walks from every word of the item
            self.walks.append((steps, *self._keys(own, steps, anchor)))

    def far(self, length: int) -> int:
        return int(self.share * length + 1e-9)

    def samples(self, length: int) -> int:
        """Steps in a key: no more than the words that as many edits as are allowed must leave side by side somewhere."""
        side_by_side = -(-(length - self.far(length)) // (self.far(length) + 1))
        return max(1, min(3 if length >= 10 else 2, side_by_side))

    @staticmethod
    def _tried(own: list[int], groups: dict[int, list[int]]) -> list[list[int]]:
        """Some items of each length class, evenly."""
        inside = set(own)
        classes = [[k for k in g if k in inside] for g in groups.values()]
        return [c[:: -(-len(c) // TRIED)] for c in classes if c]

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix64(a.astype(np.uint64) * np.uint64(1 << 32) + b.astype(np.uint64)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)

    def _keys(self, own: list[int], steps: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of walks from all anchors of items, and for each the item and the anchor."""
        flat, starts, ends = _laid([self.items[k][1] for k in own])
        at = [np.arange(s, max(s + 1, e - 1), anchor) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = np.repeat(np.arange(len(own)), [len(a) for a in at])
        begin = np.concatenate(at)
        keys, inside = walk(flat, begin, ends[number], steps, with_ends=True)
        table, column = np.nonzero(inside)  # a walk that left its item says nothing of it
        keys = keys[table, column]
        order = np.argsort(keys, kind="stable")
        column = column[order]
        return keys[order], np.array(own)[number[column]], begin[column] - starts[number[column]]

    def worst(self, tried: list[list[int]], steps: np.ndarray, anchor: int, rng) -> float:
        """The least share, over length classes and shapes of edits, of items that are found again after as many edits as allowed."""
        out = 1.0
        for own in tried:
            keys, which, _ = self._keys(own, steps, anchor)
            for shape in SHAPES:
                source = np.repeat(own, -(-2 * TRIED // len(own)))
                edited = [planted(self.items[k][1], self.far(len(self.items[k][1])), shape, rng) for k in source.tolist()]
                flat, starts, ends = _laid(edited)
                begin = np.arange(len(flat))
                text = np.repeat(np.arange(len(edited)), ends - starts)
                got = walk(flat, begin, ends[text], steps)
                lo, hi = np.searchsorted(keys, got, side="left"), np.searchsorted(keys, got, side="right")
                found = np.zeros(len(edited), dtype=bool)
                for r, c in np.argwhere(hi > lo).tolist():
                    if not found[text[c]]:
                        found[text[c]] = source[text[c]] in which[lo[r, c] : hi[r, c]]
                out = min(out, float(found.mean()))
        return out

    def _whole_runs(self, flat: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        for n, runs in self.runs.items():
            if len(flat) < n:
                continue
            ok = np.isin(_run_keys(np.lib.stride_tricks.sliding_window_view(flat, n)), self.run_keys[n]) & (doc[n - 1 :] == doc[: len(doc) - n + 1])
            seen = set()
            for at in np.flatnonzero(ok).tolist():
                run, d = tuple(flat[at : at + n].tolist()), int(doc[at])
                if run in runs and (d, run) not in seen:
                    seen.add((d, run))
                    yield from ((d, i, n, 0, at + n - int(first[d])) for i in runs[run])

    @staticmethod
    def _window(cell, length, far, lo, hi):
        """Where an item that begins in a cell (of its own length) may lie."""
        return np.maximum(lo, cell * length - 2 * far), np.minimum(hi, (cell + 2) * length + 2 * far)

    def _likely(self, cells: np.ndarray, flat: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Candidates whose window holds as many of the item's own word pairs as the q-gram bound asks for."""
        codes = np.zeros(len(flat), dtype=np.uint64)
        codes[:-1] = flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:].astype(np.uint64)
        out = [cells[:0]]
        for begin in range(0, len(cells), STARTS):
            part = cells[begin : begin + STARTS]
            d, k, cell = part.T
            length = self.lengths[k]
            far = (self.share * length + 1e-9).astype(np.int64)
            a, b = self._window(cell, length, far, first[d], ends[d])
            size = np.maximum(b - a - 1, 0)
            at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            key = mix64(codes[at] + np.repeat(k.astype(np.uint64), size) * np.uint64(0x9E3779B97F4A7C15))
            own = self.own_pairs[np.minimum(np.searchsorted(self.own_pairs, key), len(self.own_pairs) - 1)] == key
            sums = np.concatenate([[0], np.cumsum(own)])
            stop = np.cumsum(size)
            out.append(part[sums[stop] - sums[stop - size] >= length - 1 - 2 * far])
        return np.concatenate(out)

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item_id, item words, distance, end in words), the best place of each pair."""
        lists = [words(t) for t in texts]
        get = self.vocabulary.get
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        n = int(counts.sum())
        if not n:
            return
        flat = np.fromiter((get(w, 0) for x in lists for w in x), dtype=np.int64, count=n)
        doc = np.repeat(np.arange(len(lists)), counts)
        ends = np.cumsum(counts)
        yield from self._whole_runs(flat, doc, ends - counts)
        if not self.items:
            return
        good = np.zeros(n, dtype=bool)
        good[:-1] = (flat[:-1] > 0) & (flat[1:] > 0) & (doc[1:] == doc[:-1])
        hit = np.flatnonzero(good)
        good[hit] = self.pairs[self.pair(flat[hit], flat[hit + 1])]
        total = np.concatenate([[0], np.cumsum(good)])
        at = np.flatnonzero(flat > 0)
        inside = lambda around: total[np.minimum(at + around, n)] - total[np.maximum(at - around, 0)]
        at = at[inside(max(a for a, _ in self.classes)) >= min(need for _, need in self.classes)]
        may = np.zeros(len(at), dtype=bool)
        for around, need in self.classes:
            may |= inside(around) >= need
        starts = at[may]
        cells, width = [np.zeros(0, dtype=np.int64)], n + 2  # (text, item, cell) as one number
        for steps, keys, which, anchors in self.walks:
            for begin in range(0, len(starts), STARTS):
                own = starts[begin : begin + STARTS]
                got = walk(flat, own, ends[doc[own]], steps)
                lo = np.searchsorted(keys, got, side="left")
                same = keys[np.minimum(lo, len(keys) - 1)] == got
                table, column = np.nonzero(same)
                lo = lo[table, column]
                many = np.searchsorted(keys, got[table, column], side="right") - lo
                key = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                column = np.repeat(column, many)
                item, place = which[key], own[column] - anchors[key]
                length, d = self.lengths[item], doc[own[column]]
                wide = (self.share * length + 1e-9).astype(np.int64)
                a, b = np.maximum(place - 2 * wide, ends[d] - counts[d]), np.minimum(place + length + 2 * wide, ends[d])
                ok = total[np.maximum(b - 1, a)] - total[a] >= length - 1 - 2 * wide
                item, cell, d = item[ok], place[ok] // length[ok], d[ok]
                cells.append(np.unique((d * len(self.items) + item) * width + cell + 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        code = np.unique(np.concatenate(cells))
        cells = np.stack([code // width // len(self.items), code // width % len(self.items), code % width - 1], axis=1)
        for d, k, cell in self._likely(cells, flat, ends - counts, ends).tolist():
            if best.get((d, k), (1, 0))[0] == 0:
                continue  # cells come in order, so the first exact place is found
            item, lo = self.items[k][1], int(ends[d] - counts[d])
            far = self.far(len(item))
            a, b = self._window(cell, len(item), far, lo, int(ends[d]))
            distance, end = nearest(item, flat[a:b], self.places[k])
            if distance <= far:
                best[(d, k)] = min(best.get((d, k), (distance, 1 << 60)), (distance, int(a) - lo + end))
        for (d, k), (distance, end) in best.items():
            yield d, self.items[k][0], len(self.items[k][1]), distance, end


def _run_keys(runs: np.ndarray) -> np.ndarray:
    key = np.zeros(len(runs), dtype=np.uint64)
    for j in range(runs.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + runs[:, j].astype(np.uint64))
    return key


def _laid(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences one after another, their starts and ends."""
    ends = np.cumsum([len(x) for x in sequences])
    return np.concatenate(sequences), ends - np.array([len(x) for x in sequences]), ends


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99) -> DataFrame:
    """doc_id, item_id, item_words, distance, end_word: pairs of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` rows
    where the document holds the item within floor(share * words) word edits (words: letters, digits, underscores; case folded).

    One row for each such pair, with the first best place that was found; end_word is where it ends, in words. ``recall`` holds for items at
    the limit of edits, for the worst of all shapes of edits and classes of lengths; items that allow no edit (under five words) are
    looked up as runs of words and always found. Null and empty texts match nothing, nor do items without words; repeated rows give
    repeated pairs; an empty table on either side gives no rows; further columns are ignored. A narrow map over whole texts for each
    block of benchmark texts, which goes to the executors with its tables; with several blocks each is written before the next.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = sorted(((r["item_id"], r["text"]) for r in numbered.where(F.col("block") == block).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent = spark.sparkContext.broadcast(Index(rows, share, recall))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for ids, texts in text_batches(batches, "doc_id", "text"):
                got = list(sent.value.find(texts))
                cols = [[ids[g[0]] for g in got], *([g[k] for g in got] for k in range(1, 5))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "item_words", "distance", "end_word"])

        part = documents(docs).mapInArrow(run, "doc_id long, item_id long, item_words int, distance int, end_word int")
        if blocks > 1:
            part = materialize(part, "leaks")
            sent.destroy()
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item.

    Rows with a null doc_id or a null or empty text stay; of rows that repeat a doc_id all go where one holds an item; an empty
    table on either side drops nothing.
    """
    bad = matches(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
