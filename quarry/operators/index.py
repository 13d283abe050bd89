"""Positional inverted indexes as DataFrames: analyzed documents, tokens, postings and what is counted over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ANALYZERS, STOP_WORDS, tokens, vbyte_length
from quarry.operators.ranking import sliced_rank


def analyzed(docs: DataFrame, analyzer: str = "main", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ts): a narrow projection; every query below starts from it."""
    return docs.select(F.col(key).alias("doc_id"), tokens(F.col(text), analyzer).alias("ts"))


def token_rows(docs: DataFrame, analyzer: str = "main", **columns) -> DataFrame:
    """(doc_id, pos, term), positions from 0."""
    return analyzed(docs, analyzer, **columns).select("doc_id", F.posexplode("ts").alias("pos", "term"))


def postings(docs: DataFrame, analyzer: str = "main", **columns) -> DataFrame:
    """(term, doc_id, tf, positions), a set of rows for each row of ``docs``.

    All tokens of a document are in one place already, so nothing is shuffled: tokens are made in the JVM, and a batch of documents
    is sorted by document and term in one stroke. Write the result sorted by term, or bucketed, to serve lookups.
    """
    return posting_rows(analyzed(docs, analyzer, **columns)).drop("dl")


def posting_rows(docs: DataFrame, marks: bool = False) -> DataFrame:
    """``postings`` of analyzed documents, with ``dl``, the tokens of the document; ``marks`` adds a row of the empty term for each."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return docs.mapInArrow(partial(_posting_rows, marks=marks), "term string, doc_id long, tf long, dl int, positions array<int>")


def sorted_posting_rows(docs: DataFrame, analyzer: str = "main", run_tokens: int = 1 << 20) -> DataFrame:
    """``posting_rows`` with marks of documents (doc_id, text), sorted by term, then document, in runs of about ``run_tokens`` tokens.

    Only the letter case is made in the JVM: what is a token is decided for all bytes of a batch at once.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    lowered = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return lowered.mapInArrow(partial(_sorted_runs, analyzer=analyzer, run_tokens=run_tokens), "term string, doc_id long, tf long, dl int, positions array<int>")


def _byte_tokens(lowered, analyzer: str):
    """What ``tokens`` gives for lower-case texts, as an Arrow list array: all analyzers look at ASCII alone, and each byte of other
    characters is no ASCII, so bytes are as good as characters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lowered = lowered.cast(pa.large_string())
    at = np.frombuffer(lowered.buffers()[1], dtype=np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    data = lowered.buffers()[2]
    text = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    inside = np.zeros(256, dtype=bool)
    inside[list(b"abcdefghijklmnopqrstuvwxyz0123456789" + (b"" if analyzer == "alnum" else b"_"))] = True
    if ANALYZERS[analyzer][0]:  # deletes all but these and white space, which joins what stands on both sides
        kept = inside.copy()
        kept[list(b" \t\n\x0b\f\r")] = True
        kept = kept[text]
        at = np.r_[0, np.cumsum(kept)][at]
        text = text[kept]
    here = inside[text]
    before = np.r_[False, here[:-1]] if len(here) else here
    before[at[at < len(here)]] = False  # a text ends a token
    start = np.flatnonzero(here & ~before)
    after = np.r_[~here[1:], True] if len(here) else here
    last = at[1:][at[1:] > 0] - 1
    after[last] = True
    length = np.flatnonzero(here & after) + 1 - start
    start, length = start[length > 1], length[length > 1]
    edge = np.zeros(len(here) + 1, dtype=np.int8)
    edge[start] = 1
    edge[start + length] -= 1
    body = text[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.r_[0, np.cumsum(length)]
    words = pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
    doc = np.searchsorted(start, at)
    words = words.dictionary_encode()
    if analyzer == "main":
        ok = ~pc.is_in(words.dictionary, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
        doc, words = np.r_[0, np.cumsum(ok)][doc], pc.filter(words, pa.array(ok, pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(doc.astype(np.int32)), words)


def _sorted_runs(batches: Iterator, analyzer: str, run_tokens: int, part_rows: int = 65536) -> Iterator:
    import pyarrow as pa

    held, tokens_held = [], 0

    def flush() -> Iterator:
        whole = pa.Table.from_batches(held).unify_dictionaries().combine_chunks().to_batches()
        for out in _posting_rows(whole, marks=True, by_term=True):
            for start in range(0, out.num_rows, part_rows):
                yield out.slice(start, part_rows)

    for batch in batches:
        if batch.num_rows:
            lists = _byte_tokens(batch.column(1), analyzer)
            held.append(pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ts"]))
            tokens_held += len(lists.values)
        if tokens_held >= run_tokens:
            yield from flush()
            held, tokens_held = [], 0
    if held:
        yield from flush()


def _posting_rows(batches: Iterator, marks: bool = False, by_term: bool = False) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        words = words if pa.types.is_dictionary(words.type) else words.dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if by_term:  # one key of term and place: places are in order of document and position
            rank = np.empty(len(words.dictionary), dtype=np.int64)
            rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
            order = np.sort(rank[code] * len(code) + np.arange(len(code))) % max(len(code), 1)
        else:
            order = np.lexsort((code, doc))
        doc, code, pos = doc[order], code[order], pos[order]
        first = np.flatnonzero(np.r_[len(doc) > 0, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
        ends = np.append(first, len(doc)).astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))
        names = ["term", "doc_id", "tf", "dl", "positions"]
        if marks:
            n = len(lengths)
            none = pa.array([[]] * n, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([""] * n), ids.cast(pa.int64()), pa.array(np.zeros(n, dtype=np.int64)), pa.array(lengths.astype(np.int32)), none], names)
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])).cast(pa.string()), ids.take(pa.array(doc[first])).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.array(lengths[doc[first]].astype(np.int32)), positions], names)


def latest(docs: DataFrame, version: str, key: str = "doc_id") -> DataFrame:
    """Upserts: of each key the row of the highest version, so that adding a document again replaces its postings."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    return docs.groupBy(key).agg(F.max_by(whole, docs[version]).alias("row")).select("row.*")


def corpus_stats(docs: DataFrame, analyzer: str = "main") -> DataFrame:
    """One row: documents, tokens and the mean length."""
    a = analyzed(docs, analyzer).select(F.size("ts").alias("dl"))
    total = F.coalesce(F.sum("dl"), F.lit(0))
    return a.agg(F.count("*").alias("n_docs"), total.alias("n_tokens"), F.coalesce(F.try_divide(total, F.count("*")), F.lit(0.0)).alias("avg_length"))


def frequencies(docs: DataFrame, analyzer: str = "main") -> DataFrame:
    """(term, frequency) of the whole vocabulary; tasks count first, so common terms are no hot keys."""
    return analyzed(docs, analyzer).select(F.explode("ts").alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))


def document_frequencies(docs: DataFrame, analyzer: str = "main") -> DataFrame:
    """(term, df): in how many documents each term is."""
    return analyzed(docs, analyzer).select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def posting_sizes(posting_rows: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """Per term: postings, bytes at eight a posting, and bytes of the gaps between sorted document ids at seven bits a byte.

    Gaps are taken within slices of the id range and the first of a slice against the last of the slice before, so that
    the posting list of a very common term is not sorted in one task.
    """
    p = posting_rows.select("term", "doc_id", F.floor(F.col("doc_id") / slice_rows).alias("part"))
    w = Window.partitionBy("term", "part").orderBy("doc_id")
    inner = p.select("term", "part", "doc_id", (F.col("doc_id") - F.lag("doc_id").over(w)).alias("gap"))
    per = inner.groupBy("term", "part").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gap").isNotNull(), vbyte_length(F.col("gap")))).alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    before = F.coalesce(F.lag("high").over(Window.partitionBy("term").orderBy("part")), F.lit(0))
    per = per.withColumn("first_bytes", vbyte_length(F.col("low") - before))
    out = per.groupBy("term").agg(F.sum("n").alias("n_postings"), F.sum(F.coalesce("bytes", F.lit(0)) + F.col("first_bytes")).alias("gap_bytes"))
    return out.select("term", "n_postings", (F.col("n_postings") * 8).alias("raw_bytes"), F.col("gap_bytes").cast("long").alias("gap_bytes"))


def skip_pointers(posting_rows: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """Every floor(sqrt(n))-th posting of a term by document id: (term, idx, doc_id)."""
    ranked = sliced_rank(posting_rows.select("term", "doc_id"), ["term"], F.floor(F.col("doc_id") / slice_rows), [F.col("doc_id")], "idx")
    return ranked.where(F.col("idx") % F.floor(F.sqrt("n_group")) == 0).select("term", "idx", "doc_id")
