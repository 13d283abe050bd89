"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A text is cut where no vocabulary piece can reach across (before runs of the space mark, around line feeds if no
longer piece holds one, between characters that never stand side by side in a piece); each segment is merged on its own, and its count is kept in a bounded cache.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, documents, text_batches

SPACE = "▁"


class PieceCounter:
    """Counts of a sentencepiece BPE model with byte fallback, a space in front and no other normalization."""

    def __init__(self, path: str, cached: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        order = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in scores.items()}
        self.bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        longer = [p for p in self.rank if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece holds a space mark after other characters; segments would not be independent")
        probe = "a  b\nﬁ Ａ "
        self.lines = not any("\n" in p for p in longer)
        #: Neighbouring characters inside pieces: elsewhere nothing can ever merge, so a text may be cut there.
        self.inside = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.most = cached
        if self.count(probe) != len(sp.encode(probe)):
            raise ValueError("the model normalizes texts in a way that this counter does not know")

    def merge(self, segment: str) -> int:
        """Pops the lowest-ranked adjacent pair (leftmost on ties) until none is left."""
        rank = self.rank
        get = rank.get
        n = len(segment)
        part: list[str | None] = list(segment)
        weight = [1] * n if not self.bytes else [1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in part]
        total = sum(weight)
        heap = [r * n + i for i in range(n - 1) if (r := get(segment[i : i + 2])) is not None]
        if not heap:
            return total
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            left, j = part[i], after[i]
            if left is None or j >= n or get(both := left + part[j]) != r:
                continue  # one of the two has merged with another meanwhile
            total += 1 - weight[i] - weight[j]
            weight[i], part[i], part[j] = 1, both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(both + part[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := get(part[h] + both)) is not None:
                heapq.heappush(heap, r * n + h)
        return total

    def atom(self, s: str) -> int:
        """The count of a piece of text within which merges may happen anywhere."""
        n = self.cache.get(s)
        if n is None:
            n = self.older.get(s)
            if n is None:
                n = self.merge(s)
            if len(s) <= 64:
                self.keep(s, n)
        return n

    def keep(self, s: str, n: int) -> None:
        if len(self.cache) >= self.most:
            self.older, self.cache = self.cache, {}
        self.cache[s] = n

    def segment(self, s: str) -> int:
        n = self.cache.get(s)
        if n is None:
            inside, total, begin = self.inside, 0, 0
            for i in range(1, len(s)):
                if s[i - 1 : i + 1] not in inside:
                    total += self.atom(s[begin:i])
                    begin = i
            if not begin:
                return self.atom(s)
            n = total + self.atom(s[begin:])
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        text = SPACE + text.replace(" ", SPACE)
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            total += k > 0
            if not line:
                continue
            get = self.cache.get
            head, *rest = line.split(SPACE)
            if head:
                total += self.segment(head)
            run = SPACE
            for word in rest[:-1]:
                if word:
                    s = run + word
                    n = get(s)
                    total += self.segment(s) if n is None else n
                    run = SPACE
                else:
                    run += SPACE
            if rest:
                total += self.segment(run + rest[-1])
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A narrow map: no shuffle. Null and empty texts have no bytes and no tokens; repeated rows and null ids are kept as
    they are; further columns are ignored. ``model_path`` must be readable on every executor.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = counter(model_path).count
        for ids, texts in text_batches(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
