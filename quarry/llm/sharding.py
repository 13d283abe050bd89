"""Shards that match the mixture of sources: proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source; sorting all rows by their fractional rank interleaves the
sources in proportion, and equal cuts of that order are the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Rows that one task is to sort at a time: ranks are taken in equal slices of the hash or rank, not in whole sources. Slices
#: are numbered in runs of SLICES_A_RUN, so that no task gets all of their counts either.
SLICE_ROWS, SLICES_A_RUN = 512, 4096


def _bits(rows: int, slice_rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / slice_rows)))


def _ranks(df: DataFrame, group: list[str], cut: Column, order: list, run: int) -> DataFrame:
    """Adds ``rank`` (from 0, within group, by ``order``, of which ``cut`` is a coarse non-decreasing form) and ``n_group``.

    Slices are counted first, then runs of slices, so no group, however large, is sorted or summed in one task.
    """
    sliced = df.withColumn("slice_", cut)
    counts = sliced.groupBy(*group, "slice_").agg(F.count("*").alias("n_")).withColumn("run_", F.floor(F.col("slice_") / run))
    runs = counts.groupBy(*group, "run_").agg(F.sum("n_").alias("n_run"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    runs = runs.select(*group, "run_", (F.sum("n_run").over(w.orderBy("run_")) - F.col("n_run")).alias("before_run"), F.sum("n_run").over(w).alias("n_group"))
    inner = F.sum("n_").over(Window.partitionBy(*group, "run_").orderBy("slice_")) - F.col("n_")
    counts = counts.withColumn("inner_", inner).join(runs, [*group, "run_"]).select(*group, "slice_", (F.col("before_run") + F.col("inner_")).alias("before_"), "n_group")
    rn = F.row_number().over(Window.partitionBy(*group, "slice_").orderBy(*order))
    return sliced.join(counts, [*group, "slice_"]).withColumn("rank", F.col("before_") + rn - 1).drop("slice_", "before_")


def proportional_shards(docs: DataFrame, n_shards: int = 16, seed: str = "shard", law: str = "rows", slice_rows: int = SLICE_ROWS, slices_a_run: int = SLICES_A_RUN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs(doc_id, text, source)``.

    Law ``rows``: counts of shards are at most one apart, and each shard holds each source in the proportion of the whole.
    Null sources are one stratum, a null doc_id is the word null in the shuffle, a null text is empty (size 1); rows of one doc_id
    with different texts go by text; rows that are equal in doc_id, source, size and text_crc32 are ordered arbitrarily among themselves;
    an empty table gives no rows; further columns are ignored. Two shuffles of narrow rows; no text is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("stratum"))
    rows = rows.withColumn("mixed", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")).cast("binary")))
    rows = rows.withColumn("r", F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long"))
    total = docs.count()
    bits = _bits(total, slice_rows)
    tie = ["mixed", "doc_id", "size"]
    ranked = _ranks(rows, ["stratum"], F.shiftright("r", 32 - bits), ["r", *tie], slices_a_run)
    ranked = ranked.withColumn("fraction", (F.col("rank") + F.lit(0.5)) / F.col("n_group")).drop("rank", "n_group")
    ranked = materialize(ranked, "shard")
    order = ["fraction", "r", *tie, "stratum"]
    placed = _ranks(ranked, [], F.floor(F.col("fraction") * F.lit(float(1 << bits))), order, slices_a_run)
    shard = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(n_shards: int = 16, seed: str = "shard") -> str:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return f"""
    with t as (select {table}::bigint[] as tbl),
    rows_ as (
      select doc_id, strlen(coalesce(text, '')) + 1 as size, coalesce('s' || source, 'n') as stratum,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
            lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))::bigint as text_crc32
      from documents, t),
    m as (select *, md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || text_crc32) as mixed from rows_),
    a as (select *, ('0x' || substr(mixed, 1, 8))::bigint as r from m),
    b as (select *, (row_number() over (partition by stratum order by r, mixed, doc_id, size) - 1 + 0.5::double) / count(*) over (partition by stratum) as fraction from a),
    c as (select *, row_number() over (order by fraction, r, mixed, doc_id, size, stratum) - 1 as rank, count(*) over () as total from b)
    select doc_id, size::bigint as size, text_crc32, 'rows' as law, (rank * {n_shards} // total)::int as shard,
      (rank - ((rank * {n_shards} // total) * total + {n_shards - 1}) // {n_shards})::bigint as slot, null::int as grown_shard
    from c"""
