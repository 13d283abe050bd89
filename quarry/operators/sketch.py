"""Sketches as DataFrames: Bloom filters, count-min tables and HyperLogLog registers, which merge by union and aggregation.

Hashes are taken from MD5 digits, so any engine can rebuild a sketch. Building is one aggregation with map-side combining: what
is shuffled is bounded by the sketch and the number of tasks, not by the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import hash32


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for ``n`` items at a false-positive rate."""
    if not 0 < rate < 1 or n <= 0:
        raise ValueError("the rate must lie between 0 and 1, and n must be positive")
    m = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    return m, max(1, math.floor(m / n * math.log(2) + 0.5))


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """The item's bits by double hashing."""
    a, b = hash32(item, 0), hash32(item, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + i * b) % (1 << 32) % m)


def bloom(items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """(bit): the set bits, m at most."""
    x = F.col(item).cast("string")
    return items.where(x.isNotNull()).select(F.explode(bloom_positions(x, m, k)).alias("bit")).distinct()


def bloom_probe(bits: DataFrame, items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """(item, maybe) for distinct items: true where all bits are set, and then with the filter's false-positive rate."""
    asked = items.select(F.col(item).cast("string").alias("item")).where("item is not null").distinct()
    each = asked.select("item", F.explode(F.array_distinct(bloom_positions(F.col("item"), m, k))).alias("bit"))
    return each.join(bits.withColumn("set", F.lit(1)), "bit", "left").groupBy("item").agg((F.count("*") == F.count("set")).alias("maybe"))


def bloom_stats(bits: DataFrame, n: int, m: int, k: int, rate: float) -> DataFrame:
    """Set bits, fill, the rates expected by size and by fill, and the number of items that the fill tells of."""
    s = bits.agg(F.count("*").alias("set_bits"))
    fill = F.col("set_bits") / m
    return s.select("set_bits", F.round(fill, 9).alias("fill"), F.lit(rate).alias("target_rate"), F.round(F.pow(1 - F.exp(F.lit(-k * n / m)), F.lit(k)), 9).alias("expected_rate"), F.round(F.pow(fill, F.lit(k)), 9).alias("rate_by_fill"), F.round(-m / k * F.log(1 - fill)).cast("long").alias("estimated_items"))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Width and depth of a count-min table."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def cms_cells(item: Column, width: int, depth: int) -> Column:
    """(row, bucket) of an item in every row."""
    return F.array(*[F.struct(F.lit(r).alias("row"), (hash32(F.concat(F.lit(f"{r}:"), item)) % width).alias("bucket")) for r in range(depth)])


def cms(items: DataFrame, item: str, width: int, depth: int) -> DataFrame:
    """(row, bucket, n). Items are counted before they are hashed, so a hot item is one row."""
    x = items.select(F.col(item).cast("string").alias("item")).where("item is not null").groupBy("item").agg(F.count("*").alias("n"))
    cells = x.select(F.explode(cms_cells(F.col("item"), width, depth)).alias("c"), "n")
    return cells.groupBy("c.row", "c.bucket").agg(F.sum("n").alias("n"))


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def cms_estimate(cells: DataFrame, items: DataFrame, item: str, width: int, depth: int) -> DataFrame:
    """(item, estimate) of distinct items: the least of its cells, never below the true count."""
    asked = items.select(F.col(item).cast("string").alias("item")).where("item is not null").distinct()
    each = asked.select("item", F.explode(cms_cells(F.col("item"), width, depth)).alias("c")).select("item", "c.row", "c.bucket")
    return each.join(cells, ["row", "bucket"], "left").groupBy("item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_registers(items: DataFrame, item: str, p: int = 10) -> DataFrame:
    """(register, rank): the largest leading-zero rank of each register that was met."""
    if not 4 <= p <= 16:
        raise ValueError("precision lies between 4 and 16")
    h = hash32(F.col("item"))
    rest = (F.shiftleft(h, p)) % (1 << 32)
    rank = F.when(rest == 0, 32 - p + 1).otherwise(32 - F.floor(F.log2(rest)))
    rows = items.select(F.col(item).cast("string").alias("item")).where("item is not null")
    return rows.select(F.shiftright(h, 32 - p).alias("register"), rank.cast("int").alias("rank")).groupBy("register").agg(F.max("rank").alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int = 10) -> DataFrame:
    """(estimate, error): harmonic mean over all registers, linear counting while some are empty and the estimate is small."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    s = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count("*").alias("full"))
    empty = m - F.col("full")
    raw = F.lit(alpha * m * m) / (F.col("s") + empty)
    value = F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / empty)).otherwise(raw)
    return s.select(F.round(value).cast("long").alias("estimate"), F.round(F.lit(1.04 / math.sqrt(m)), 6).alias("error"))
