"""Embeddings of texts by character pairs, cosine similarity and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 64
#: a-z and 0-9 as they are, a space for everything else.
_PLAIN = np.array([c if chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(128)], dtype=np.uint8)
#: Query vectors that are sent to every task; more are dealt.
BLOCK = 1024


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by a pair of neighbouring characters; all but a-z and 0-9 counts as a space, pairs of spaces
    are left out."""
    x = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8)
    plain = _PLAIN[x].astype(np.int64)
    a, b = plain[:-1], plain[1:]
    return np.bincount(((31 * a + b) % DIMENSIONS)[(a != 32) | (b != 32)], minlength=DIMENSIONS)


def _per_document(docs: DataFrame, fn, schema: str) -> DataFrame:
    """A narrow map over whole texts in small batches; a null text is empty."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield fn(batch.column(0).to_pylist(), [bucket_counts(t or "") for t in batch.column(1).to_pylist()])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def embedded(docs: DataFrame) -> DataFrame:
    """(doc_id, bucket, weight): counts scaled to length one; a text without pairs has no rows."""

    def rows(ids: list, counts: list[np.ndarray]):
        import pyarrow as pa

        x = np.array(counts, dtype=np.float64).reshape(len(ids), DIMENSIONS)
        at, bucket = np.nonzero(x)
        weight = x[at, bucket] / np.sqrt((x * x).sum(1))[at]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(bucket.astype(np.int32)), pa.array(weight)], ["doc_id", "bucket", "weight"])

    return _per_document(docs, rows, "doc_id long, bucket int, weight double")


def query_weights(query: str) -> dict[int, float]:
    """The embedding of a query, by bucket."""
    counts = bucket_counts(query)
    length = math.sqrt(int((counts * counts).sum()))
    return {int(k): float(counts[k] / length) for k in np.flatnonzero(counts)}


def text_similarity(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, similarity) of every document with pairs to a query."""
    weights = np.zeros(DIMENSIONS)
    for k, w in query_weights(query).items():
        weights[k] = w

    def rows(ids: list, counts: list[np.ndarray]):
        import pyarrow as pa

        x = np.array(counts, dtype=np.float64).reshape(len(ids), DIMENSIONS)
        length = np.sqrt((x * x).sum(1))
        ok = np.flatnonzero(length)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(ok)), pa.array((x[ok] @ weights) / length[ok])], ["doc_id", "similarity"])

    return _per_document(docs, rows, "doc_id long, similarity double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length; other sizes are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a) * dot(b, b))
    value = F.when(length == 0, 0.0).otherwise(dot(a, b) / length)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different sizes"))).otherwise(value)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _matrix(vectors: list) -> np.ndarray:
    return _unit(np.array(vectors, dtype=np.float64).reshape(len(vectors), -1))


def _column_matrix(column) -> np.ndarray:
    """The unit vectors of an Arrow column of lists, without a Python object a number; other sizes are an error."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different sizes")
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1))


def _planes(size: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, tables * bits))


def _codes(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """A code a row and table: the signs of seeded random projections."""
    return ((x @ _planes(x.shape[1], tables, bits, seed) > 0).reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(2)


#: Tables, bits and seed of hyperplanes: only pairs whose codes differ by one bit at most in some table are compared.
Probes = tuple[int, int, int]
#: Queries and rows that are compared at once; the similarities of so many pairs are all that a task holds besides its rows.
TILE, STEP, FIRST_STEP = 1024, 2048, 128


class _Best:
    """The ``k`` nearest of the rows seen so far to each query of a tile, held as flat (query, name, similarity) in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, probes: Probes | None = None):
        self.ids, self.x, self.k, self.probes = ids, x, k, probes
        self.codes = _codes(x, *probes) if probes and len(x) else None
        self.at, self.name, self.sim = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)
        if probes:
            self.close = np.array([c & (c - 1) == 0 for c in range(1 << probes[1])])

    def add(self, name: np.ndarray, y: np.ndarray, codes: np.ndarray | None = None) -> None:
        start = 0
        step = STEP if len(self.at) else FIRST_STEP  # the first rows are all candidates, so there are few of them
        while start < len(y):
            end = start + step
            self._tile(name[start:end], y[start:end], None if codes is None else codes[start:end])
            self._keep()
            start, step = end, min(STEP, step * 4)

    def _tile(self, name: np.ndarray, y: np.ndarray, codes: np.ndarray | None) -> None:
        """Candidates are those that round to the ``k``-th similarity so far or more; only these are rounded and probed."""
        sims = self.x @ y.T
        at, row = np.divmod(np.flatnonzero(sims >= self.floor[:, None] - 1e-6), max(len(y), 1))
        sim = np.round(sims[at, row], 6)
        ok = (sim >= self.floor[at]) & (self.ids[at] != name[row])
        at, row, sim = at[ok], row[ok], sim[ok]
        if codes is not None:
            ok = np.zeros(len(at), dtype=bool)
            for t in range(codes.shape[1]):
                ok |= self.close[self.codes[at, t] ^ codes[row, t]]
            at, row, sim = at[ok], row[ok], sim[ok]
        self.at, self.name, self.sim = np.r_[self.at, at], np.r_[self.name, name[row]], np.r_[self.sim, sim]

    def _keep(self) -> None:
        order = np.lexsort((self.name, -self.sim, self.at))
        at = self.at[order]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))
        order, place = order[place < self.k], place[place < self.k]
        self.at, self.name, self.sim = self.at[order], self.name[order], self.sim[order]
        last = place == self.k - 1
        self.floor[self.at[last]] = self.sim[last]


class _Tiles:
    """``_Best`` of tile after tile of the queries, so that candidates of one tile alone are in memory."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, probes: Probes | None = None):
        self.probes, self.tiles = probes, [_Best(ids[q : q + TILE], x[q : q + TILE], k, probes) for q in range(0, len(ids), TILE)]

    def add(self, name: np.ndarray, y: np.ndarray) -> None:
        codes = _codes(y, *self.probes) if self.probes and len(y) else None
        for best in self.tiles:
            best.add(name, y, codes)

    def columns(self) -> list:
        import pyarrow as pa

        join = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, dtype=kind), *parts]))
        return [join([b.ids[b.at] for b in self.tiles], np.int64), join([b.name for b in self.tiles], np.int64), join([b.sim for b in self.tiles], np.float64)]


_NEAR = "query_id long, vec_id long, similarity double"
_NEAR_NAMES = ["query_id", "vec_id", "similarity"]


def _nearest_of_few(rows: DataFrame, asked: DataFrame, k: int, probes: Probes | None = None) -> DataFrame:
    """At most ``BLOCK`` queries go to every task, and the rows stay where they are."""
    own = asked.collect()
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in own]), _matrix([r["embedding"] for r in own])))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = _Tiles(*sent.value, k, probes)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(zero_copy_only=False), _column_matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays(best.columns(), _NEAR_NAMES)

    return rows.mapInArrow(run, _NEAR)


def _nearest_in_tiles(rows: DataFrame, asked: DataFrame, k: int, blocks: int, slices: int, probes: Probes | None = None, step: int = 8192) -> DataFrame:
    """Queries in blocks by rows in slices: a task has one block and one slice, unpacks ``step`` rows at a time, and keeps ``k`` a query."""

    def run(key, data, queries):
        import pyarrow as pa

        ids = queries.column("vec_id").to_numpy()
        if not len(ids) or not data.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], _NEAR_NAMES)
        best = _Tiles(ids, _column_matrix(queries.column("embedding")), k, probes)
        for start in range(0, data.num_rows, step):
            part = data.slice(start, step)
            best.add(part.column("vec_id").to_numpy(), _column_matrix(part.column("embedding")))
        return pa.table(best.columns(), _NEAR_NAMES)

    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", "embedding", place(slices).alias("slice"), every(blocks).alias("block"))
    queries = asked.select("vec_id", "embedding", place(blocks).alias("block"), every(slices).alias("slice"))
    return data.groupBy("slice", "block").cogroup(queries.groupBy("slice", "block")).applyInArrow(run, _NEAR)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, asked_rows: int = 32768, slice_rows: int = 65536, probes: Probes | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` nearest of all rows of ``vectors(vec_id, embedding)`` to each of ``queries``,
    itself not included. Null vectors are near nothing. Ids are distinct in both.

    Exact. Up to ``block`` queries are sent to every task. More are dealt in blocks of about ``asked_rows`` against slices of about
    ``slice_rows`` vectors, a task for each two: nothing but counts reaches the driver, and a task holds one block and one slice at most,
    and the similarities of a tile of them. Either way a task keeps ``k`` rows a query, and only those are ranked.
    """
    rows = vectors.select("vec_id", "embedding").where("embedding is not null")
    asked = queries.select("vec_id", "embedding").where("embedding is not null")
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{_NEAR}, rank long")
    if n <= block:
        best = _nearest_of_few(rows, asked, k, probes)
    else:
        slices = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // slice_rows))
        best = _nearest_in_tiles(rows, asked, k, -(-n // asked_rows), slices, probes)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def signatures(vectors: DataFrame, tables: int = 12, bits: int = 6, seed: int = 7) -> DataFrame:
    """(vec_id, table, code): the signs of seeded random projections, ``bits`` of them in each table."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                codes = _codes(_column_matrix(batch.column(1)), tables, bits, seed)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(ids))), pa.array(codes.ravel().astype(np.int32))], ["vec_id", "table", "code"])

    return vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, "vec_id long, table int, code int")


def nearest_lsh(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 12, bits: int = 6, seed: int = 7, **tiles) -> DataFrame:
    """As ``nearest``, but only rows whose signature in some table is the query's or one bit off count; by their true cosine.

    So few bits make most pairs meet, so pairs are not written as rows: the tiles of ``nearest`` judge codes in place.
    """
    return nearest(vectors, queries, k, probes=(tables, bits, seed), **tiles)
