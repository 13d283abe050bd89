"""Enumeration and dynamic programming over small inputs, as projections: a step explodes choices and filters them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def knapsack(items: DataFrame, weight: str, value: str, capacity: int, names: str) -> DataFrame:
    """(value, weight, chosen): the best subset within the capacity; of equal ones that with fewer kilos, then names in order.

    One fold over the items, which are few, carries the best choice for each capacity.
    """
    item = F.struct(F.col(names).alias("name"), F.col(weight).cast("int").alias("w"), F.col(value).cast("double").alias("v"))
    row = items.agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("w"), F.array().cast("array<string>").alias("names"))

    def better(a: Column, b: Column) -> Column:
        return F.when((b["v"] > a["v"]) | ((b["v"] == a["v"]) & (b["w"] < a["w"])), b).otherwise(a)

    def add(best: Column, x: Column) -> Column:
        def cell(old: Column, c: Column) -> Column:
            base = F.element_at(best, c - x["w"] + 1)
            taken = F.struct((base["v"] + x["v"]).alias("v"), (base["w"] + x["w"]).alias("w"), F.concat(base["names"], F.array(x["name"])).alias("names"))
            return F.when((x["w"] >= 0) & (x["w"] <= c), better(old, taken)).otherwise(old)

        return F.transform(best, cell)

    last = F.aggregate("items", F.array_repeat(empty, capacity + 1), add, lambda acc: F.element_at(acc, capacity + 1))
    return row.select(last.alias("b")).select(F.col("b.v").alias("value"), F.col("b.w").alias("weight"), F.array_join("b.names", ",").alias("chosen"))


def coin_change(amounts: DataFrame, amount: str, coins: list[int], most: int) -> DataFrame:
    """(amount, coins): the least number of coins of each amount up to ``most``, -1 where there is none."""
    never = 1 << 29
    options = lambda acc: F.array_min(F.array(F.lit(never), *[F.when(F.size(acc) >= c, F.element_at(acc, -c) + 1).otherwise(F.lit(never)) for c in coins]))
    table = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.lit(0)), lambda acc, _: F.concat(acc, F.array(options(acc))))
    least = F.element_at(table, F.col(amount).cast("int") + 1)
    return amounts.select(F.col(amount).alias("amount"), F.when(least >= never, -1).otherwise(least).cast("long").alias("coins"))


def queens(spark: SparkSession, n: int) -> DataFrame:
    """(board): columns of the queens row by row, comma-joined. One fold over rows extends all boards and drops those in check."""
    grown = f"flatten(transform(boards, b -> transform(sequence(0, {n} - 1), c -> concat(b, array(c)))))"
    clash = "exists(sequence(0, size(b) - 2), i -> size(b) > 1 and i >= 0 and (b[i] = b[size(b) - 1] or abs(b[i] - b[size(b) - 1]) = size(b) - 1 - i))"
    boards = F.expr(f"aggregate(sequence(1, {n}), array(cast(array() as array<int>)), (boards, r) -> filter({grown}, b -> size(b) = 1 or not {clash}))")
    return spark.range(1).select(F.explode(boards).alias("q")).select(F.array_join(F.col("q").cast("array<string>"), ",").alias("board"))


def power_set(items: DataFrame, name: str) -> DataFrame:
    """(subset): all subsets of the sorted distinct items, comma-joined, by the bits of a counter."""
    row = items.agg(F.array_sort(F.collect_set(name)).alias("xs"))
    each = row.select("xs", F.explode(F.expr("sequence(0L, shiftleft(1L, size(xs)) - 1)")).alias("bits"))
    chosen = F.expr("filter(xs, (x, i) -> (shiftrightunsigned(bits, i) & 1) = 1)")
    return each.select(F.array_join(chosen, ",").alias("subset"))


def permutations(items: DataFrame, name: str, n: int) -> DataFrame:
    """(permutation): of ``n`` distinct items, comma-joined."""
    rows = items.agg(F.collect_set(name).alias("left")).select("left", F.array().cast("array<string>").alias("p"))
    for _ in range(n):
        rows = rows.select("left", "p", F.explode("left").alias("x")).select(F.array_remove("left", F.col("x")).alias("left"), F.concat("p", F.array("x")).alias("p"))
    return rows.select(F.array_join("p", ",").alias("permutation"))


def combination_sum(spark: SparkSession, candidates: list[int], target: int) -> DataFrame:
    """(combination): multisets of candidates, ascending, that sum to the target."""
    cs = sorted(set(candidates))
    rows = spark.range(1).select(F.array().cast("array<int>").alias("c"), F.lit(target).alias("rest"), F.lit(0).alias("last"))
    done = rows.where("rest = 0")
    for _ in range(target // max(1, cs[0]) if cs else 0):
        rows = rows.where("rest > 0").select("c", "rest", "last", F.explode(F.array(*[F.lit(x) for x in cs])).alias("x"))
        rows = rows.where("x >= last and x <= rest").select(F.concat("c", F.array("x")).alias("c"), (F.col("rest") - F.col("x")).alias("rest"), F.col("x").alias("last"))
        done = done.union(rows.where("rest = 0"))
    return done.select(F.array_join(F.col("c").cast("array<string>"), ",").alias("combination"))


def solve_sudoku(board: str) -> str | None:
    """Fills the dots of an 81-character board; null where there is no solution. The cell with the fewest options goes first."""
    cells = [0 if c == "." else int(c) for c in board]
    sees = [{j for j in range(81) if j != i and (j // 9 == i // 9 or j % 9 == i % 9 or (j // 27 == i // 27 and j % 9 // 3 == i % 9 // 3))} for i in range(81)]
    if any(cells[i] and cells[i] in {cells[j] for j in sees[i]} for i in range(81)):
        return None

    def fill() -> bool:
        best, options = None, set(range(10))
        for i in range(81):
            if not cells[i]:
                free = set(range(1, 10)) - {cells[j] for j in sees[i]}
                if len(free) < len(options):
                    best, options = i, free
        if best is None:
            return True
        for d in sorted(options):
            cells[best] = d
            if fill():
                return True
        cells[best] = 0
        return False

    return "".join(map(str, cells)) if fill() else None


def sudoku(boards: DataFrame, column: str = "board") -> DataFrame:
    """(board, solution)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            boards_ = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(boards_, pa.string()), pa.array([None if x is None or len(x) != 81 else solve_sudoku(x) for x in boards_], pa.string())], ["board", "solution"])

    return boards.select(column).mapInArrow(run, "board string, solution string")
