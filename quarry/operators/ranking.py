"""Top-k, heaps as rows, rank fusion and growth classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best, descending. Each task keeps ``k`` rows, so what meets at the end is ``k`` a task."""
    return rows.orderBy(F.desc(score), tie).limit(k)


def heap(rows: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best as a min-heap in array order: (idx, level, parent, ...). Only ``k`` rows are numbered."""
    n = F.row_number().over(Window.orderBy(score, tie)) - 1
    idx = F.col("idx")
    parent = F.when(idx > 0, F.floor((idx - 1) / 2))
    return top(rows, score, tie, k).withColumn("idx", n.cast("long")).select("idx", F.floor(F.log2(idx + 1)).alias("level"), parent.alias("parent"), tie, score)


def reciprocal_ranks(left: DataFrame, right: DataFrame, key: str, k: int = 60) -> DataFrame:
    """(key, rank_a, rank_b, rrf): a full outer join of two ranked lists ``(key, rank)``; a list without the key adds nothing."""
    a, b = left.select(key, F.col("rank").alias("rank_a")), right.select(key, F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, "rank_a", "rank_b", (part("rank_a") + part("rank_b")).alias("rrf"))


def ranked(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best with their rank from 1; the window runs over these ``k`` rows only."""
    best = top(rows, score, key, k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("long"))


def sliced_rank(rows: DataFrame, group: list[str], cut: Column, order: list, name: str = "rank") -> DataFrame:
    """Adds the place, from 0, of each row within its group by ``order``, and ``n_group``, the size of the group.

    ``cut`` is a coarse non-decreasing form of the order. Slices are counted first, and the counts before a slice are added to
    the place within it: no group, however large, is sorted in one task.
    """
    sliced = rows.withColumn("cut_", cut)
    counts = sliced.groupBy(*group, "cut_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = counts.select(*group, "cut_", (F.sum("n_").over(w.orderBy("cut_")) - F.col("n_")).alias("before_"), F.sum("n_").over(w).alias("n_group"))
    place = F.row_number().over(Window.partitionBy(*group, "cut_").orderBy(*order)) - 1
    return sliced.join(before, [*group, "cut_"]).withColumn(name, (F.col("before_") + place).cast("long")).drop("cut_", "before_")


def ranked_all(rows: DataFrame, score: str, key: str, step: float = 1 / 256) -> DataFrame:
    """All rows with their rank from 1, best first, without a sort of all rows in one task.

    Slices are ``step`` wide, so there are at most (range / step) of them.
    """
    out = sliced_rank(rows, [], -F.floor(F.col(score) / step), [F.desc(score), F.col(key)])
    return out.withColumn("rank", F.col("rank") + 1).drop("n_group")


def complexity(rows: DataFrame, group: str, size: str, time: str) -> DataFrame:
    """The growth class by the ratio of the largest to the smallest measurement."""
    r = rows.groupBy(group).agg((F.max(size) / F.min(size)).alias("s"), (F.max_by(time, size) / F.min_by(time, size)).alias("t"), F.count("*").alias("n"))
    s, t = F.col("s"), F.col("t")
    name = F.when(F.col("n") < 2, "Unknown").when(t < F.log2(s) * 1.5, "O(log n)").when(t < s * 1.5, "O(n)").when(t < s * F.log2(s) * 1.5, "O(n log n)").when(t < s * s * 1.5, "O(n²)")
    return r.select(group, name.otherwise("O(n^k) or worse").alias("complexity"))
