"""String comparison: edit scripts, common subsequences, repeated and covering substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by one fold over ``a`` that carries a row of the table; null if either is null."""
    bs = F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.array_repeat(F.lit(0), F.size(bs) + 1)

    def row(above: Column, c: Column) -> Column:
        cells = F.zip_with(bs, F.zip_with(F.slice(above, 1, F.size(bs)), F.slice(above, 2, F.size(bs)), lambda d, u: F.struct(d.alias("d"), u.alias("u"))), lambda x, du: F.when(x == c, du["d"] + 1).otherwise(du["u"]))
        return F.aggregate(cells, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.greatest(v, F.element_at(acc, -1)))))

    chars = F.filter(F.split(a, ""), lambda c: c != "")
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(chars, zero, row, lambda acc: F.element_at(acc, -1)))


def edit_ops(a: str, b: str) -> str:
    """The script from ``a`` to ``b``, from the left: = keeps, + inserts, - deletes, ~ replaces; a diagonal step is preferred."""
    n, m = len(a), len(b)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        above, row = cost[-1], [i]
        for j in range(1, m + 1):
            row.append(above[j - 1] if a[i - 1] == b[j - 1] else 1 + min(above[j - 1], above[j], row[-1]))
        cost.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            out.append("=")
            i, j = i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            out.append("~")
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out.append("-")
            i -= 1
        else:
            out.append("+")
            j -= 1
    return "".join(reversed(out))


def edit_scripts(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, script) for each row; null where either string is null. Meant for short strings: time and memory are len(a) * len(b)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, xs, ys = (batch.column(i) for i in range(3))
            scripts = [None if x is None or y is None else edit_ops(x, y) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(scripts, pa.string())], ["key", "script"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(F.col(key).alias("key"), F.col(a), F.col(b)).mapInArrow(run, f"key {kind}, script string").withColumnRenamed("key", key)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice at least, and for these a number for each distinct key, smaller than how many there are."""
    if len(key) and key.max() < 8 * len(key):
        many = np.bincount(key) > 1
        ok = many[key]
        return ok, (np.cumsum(many) - 1)[key[ok]]
    order = np.argsort(key)
    new = np.r_[True, key[order[1:]] != key[order[:-1]]] if len(key) else np.zeros(0, dtype=bool)
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1 if len(key) else new
    ok, number = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=np.int64)
    ok[order], number[order] = many[group], (np.cumsum(many) - 1)[group]
    return ok, number[ok]


def repeated_runs(texts: list[str]) -> list[tuple[str, int]]:
    """For each text the longest substring that occurs twice (overlaps allowed), and its first start; of several, the one that is first.

    All texts at once: starts whose substring of 1, 2, 4, ... characters is repeated get its number, from those of its halves; then lengths
    between two powers are told bit by bit. Exact, no hashes; what is unique is left out, so the starts get fewer from length to length.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    at = np.arange(len(end))
    ok, number = _repeated(owner * max(len(letters[0]), 1) + letters[1])
    at, levels, length = at[ok], [], 1
    while len(at):  # levels: for 2**k characters, the starts and numbers of repeated substrings, and the number by start
        by_start = np.full(len(end), -1, dtype=np.int32)
        by_start[at] = number
        levels.append((at, number, by_start))
        at, key = _longer(at, number, np.int64(length), by_start, end)
        ok, number = _repeated(key)
        at, length = at[ok], 2 * length
    found = np.zeros(len(texts), dtype=np.int64)
    at = number = np.zeros(0, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        if len(at):
            more, key = _longer(at, number, found[owner[at]], levels[k][2], end)
            ok, numbers = _repeated(key)
            more = more[ok]
            grown = np.zeros(len(texts), dtype=bool)
            grown[owner[more]] = True
            stay = ~grown[owner[at]]
            found[grown] += 1 << k
            at, number = np.r_[at[stay], more], np.r_[number[stay], numbers + (number.max() + 1)]
        begun = found == 0
        own = begun[owner[levels[k][0]]]
        first, numbers = levels[k][0][own], levels[k][1][own]
        found[np.unique(owner[first])] = 1 << k
        at, number = np.r_[at, first], np.r_[number, numbers + (number.max() + 1 if len(number) else 0)]
        number = np.unique(number, return_inverse=True)[1]
    start = np.full(len(texts), len(end), dtype=np.int64)
    np.minimum.at(start, owner[at], at)
    start -= np.cumsum(sizes) - sizes
    return [(t[a : a + n], a) if n else ("", -1) for t, a, n in zip(texts, start.tolist(), found.tolist(), strict=True)]


def _longer(at: np.ndarray, number: np.ndarray, length: np.ndarray, by_start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts whose ``length`` characters are followed, in the same text, by a numbered substring, and a key of both."""
    then = at + length
    ok = then < end[at]
    at, number, then = at[ok], number[ok], then[ok]
    after = by_start[then].astype(np.int64)
    ok = after >= 0
    return at[ok], number[ok] * (by_start.max() + np.int64(1)) + after[ok]


def repeated_run(text: str) -> tuple[str, int]:
    """``repeated_runs`` of one text."""
    return repeated_runs([text])[0]


def cover(text: str, pattern: str) -> tuple[int, int] | None:
    """Start and end (exclusive) of the shortest, then first, window that holds all characters of ``pattern`` with multiplicity."""
    if not pattern or not text:
        return None
    need: dict[str, int] = {}
    for c in pattern:
        need[c] = need.get(c, 0) + 1
    missing, left, best = len(pattern), 0, None
    for right, c in enumerate(text):
        if c in need:
            missing -= need[c] > 0
            need[c] -= 1
            while missing == 0:
                if best is None or right + 1 - left < best[1] - best[0]:
                    best = (left, right + 1)
                d = text[left]
                if d in need:
                    need[d] += 1
                    missing += need[d] > 0
                left += 1
        elif missing == len(pattern):
            left = right + 1
    return best


def _per_text(docs: DataFrame, fn, schema: str) -> DataFrame:
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            rows = list(fn([t or "" for t in batch.column(1).to_pylist()]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kinds[p.split()[1]]) for c, p in zip(cols, schema.split(", "), strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def longest_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, piece) for each document; start -1 and length 0 where nothing occurs twice. A narrow map."""

    def some(texts: list[str], most: int = 1 << 19) -> Iterator:
        held, size = [], 0
        for t in [*texts, None]:
            if held and (t is None or size + len(t) > most):
                yield from ((at, len(piece), piece) for piece, at in repeated_runs(held))
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)

    return _per_text(docs, some, "start int, length int, piece string")


def min_window(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, start, length, piece) of the shortest window with all characters of ``pattern``; start -1 where there is none."""

    def one(t: str) -> tuple:
        w = cover(t, pattern)
        return (w[0], w[1] - w[0], t[w[0] : w[1]]) if w else (-1, 0, "")

    return _per_text(docs, lambda texts: map(one, texts), "start int, length int, piece string")
