"""Operators over ordered sequences: running sums, range aggregates, next greater and smaller elements, subsequences, caches.

What a window frame or a sum can express stays in the JVM. The stack- and state-based ones stream their rows, sorted by group and
order, through one task a group: what is held is the state (a stack, a list of tails, a cache), never the group. Least-recently-used
caches are replayed slice by slice.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import sliced_rank


def positions(rows: DataFrame, group: str, order: list[str], cut: Column) -> DataFrame:
    """Adds ``idx``, from 0, within the group; ``cut`` is a coarse non-decreasing form of the order."""
    return sliced_rank(rows, [group], cut, [F.col(c) for c in order], "idx").drop("n_group")


def running_sum(rows: DataFrame, group: str, order: list[str], value: str, cut: Column, name: str = "running") -> DataFrame:
    """Adds the sum of ``value`` up to each row. ``cut`` is a coarse non-decreasing form of the order: sums of whole slices are
    added up first, so no group, however large, runs through one task."""
    sliced = rows.withColumn("cut_", cut)
    sums = sliced.groupBy(group, "cut_").agg(F.sum(value).alias("s_"))
    before = F.coalesce(F.sum("s_").over(Window.partitionBy(group).orderBy("cut_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inner = F.sum(value).over(Window.partitionBy(group, "cut_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sliced.join(sums.select(group, "cut_", before.alias("b_")), [group, "cut_"]).withColumn(name, F.col("b_") + inner).drop("cut_", "b_")


def range_aggregate(rows: DataFrame, ranges: DataFrame, group: str, value: str) -> DataFrame:
    """Sum, least and largest of the values at positions ``low`` to ``high`` of each of ``ranges(group, low, high)``; 0 and nulls
    where a range holds nothing."""
    hit = ranges.join(rows.select(group, "idx", value), group, "left").where(F.col("idx").isNull() | F.col("idx").between(F.col("low"), F.col("high")))
    got = hit.groupBy(group, "low", "high").agg(F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return ranges.join(got, [group, "low", "high"], "left").select(group, "low", "high", F.coalesce("total", F.lit(0.0)).alias("total"), "least", "largest")


def sliding_max(rows: DataFrame, group: str, order: list[str], value: str, k: int) -> DataFrame:
    """The largest of each full window of ``k`` rows."""
    w = Window.partitionBy(group).orderBy(*order)
    out = rows.withColumn("n_", F.row_number().over(w)).withColumn("window_max", F.max(value).over(w.rowsBetween(1 - k, 0)))
    return out.where(F.col("n_") >= max(k, 1)).where(F.lit(k > 0)).drop("n_")


def scan(rows: DataFrame, group: str | list[str], order: list[str], columns: list[str], start: Callable, schema: str) -> DataFrame:
    """Streams rows by group and order through a state: ``start()`` gives (step, end), which take a row or nothing, and yield rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [group] if isinstance(group, str) else group
    n = len(groups)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        target = pa.schema(kinds)
        at, step, end = None, None, None
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols, strict=True):
                g = row[:n]
                if step is None or g != at:
                    if end is not None:
                        out += [(*at, *r) for r in end()]
                    at, (step, end) = g, start()
                out += [(*g, *r) for r in step(*row[n:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)
        if end is not None:
            out = [(*at, *r) for r in end()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

    import pyarrow as pa

    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    whole = ", ".join([*(f"{g} {kind_of(rows, g)}" for g in groups), schema])
    kinds = [(p.split()[0], types[p.split()[1]]) for p in whole.split(", ")]
    dealt = rows.repartition(parts, *groups).sortWithinPartitions(*groups, *order).select(*groups, *columns)
    return dealt.mapInArrow(run, whole)


def kind_of(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString().replace("bigint", "long")


def next_greater() -> tuple:
    """(idx, next): the position of the next strictly greater value, or -1."""
    stack: list[tuple[float, int]] = []
    n = 0

    def step(v):
        nonlocal n
        while stack and v is not None and stack[-1][0] < v:
            yield stack.pop()[1], n
        if v is None:
            yield n, -1
        else:
            stack.append((v, n))
        n += 1

    return step, lambda: [(i, -1) for _, i in stack]


def previous_smaller() -> tuple:
    """(idx, previous): the position of the last strictly smaller value before, or -1."""
    stack: list[tuple[float, int]] = []
    n = 0

    def step(v):
        nonlocal n
        if v is None:
            out = (n, -1)
        else:
            while stack and stack[-1][0] >= v:
                stack.pop()
            out = (n, stack[-1][1] if stack else -1)
            stack.append((v, n))
        n += 1
        return [out]

    return step, lambda: []


def largest_rectangle() -> tuple:
    """(area): the largest rectangle below the histogram of the values; null and negative values count as 0."""
    stack: list[tuple[float, int]] = []
    n, best = 0, 0.0

    def push(v: float) -> None:
        nonlocal best
        at = n
        while stack and stack[-1][0] >= v:
            h, at = stack.pop()
            best = max(best, h * (n - at))
        stack.append((v, at))

    def step(v):
        nonlocal n
        push(max(v or 0.0, 0.0))
        n += 1
        return []

    def end():
        push(0.0)
        return [(float(best),)]

    return step, end


def inversions() -> tuple:
    """(n): pairs in which the earlier value is strictly greater. Values are held in sorted runs, each longer than the next, so a
    value costs the square of the logarithm of those before it."""
    runs: list[list[float]] = []
    total = 0

    def step(v):
        nonlocal total
        if v is not None:
            total += sum(len(run) - bisect_right(run, v) for run in runs)
            last = [v]
            while runs and len(runs[-1]) <= len(last):
                last = sorted(runs.pop() + last)
            runs.append(last)
        return []

    return step, lambda: [(total,)]


def increasing() -> tuple:
    """(length): of the longest strictly increasing subsequence; nulls are passed over."""
    tails: list[float] = []

    def step(v):
        if v is not None:
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        return []

    return step, lambda: [(len(tails),)]


def lru(capacity: int) -> Callable:
    """(seq, key, hit) of each access to a least-recently-used cache."""

    def start() -> tuple:
        held: OrderedDict = OrderedDict()

        def step(seq, key):
            hit = key in held
            held[key] = None
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
            return [(seq, key, hit)]

        return step, lambda: []

    return start


def lru_hits(rows: DataFrame, group: str, seq: str, key: str, capacity: int, cut: Column) -> DataFrame:
    """(group, seq, key, hit) of each access to the group's least-recently-used cache; null keys are a key, null groups a group,
    accesses of one ``seq`` come in any order.

    What such a cache holds is the ``capacity`` keys accessed last, so caches add up. ``cut`` is a coarse non-decreasing form of
    ``seq``: each slice is reduced to its ``capacity`` last keys first, these alone run through one task a group and give
    what is held where each slice begins, and slices are then replayed apart from each other. No group, however large,
    is replayed in one task.
    """
    sliced = rows.select(F.col(group), F.col(seq).alias("seq"), F.col(key).alias("key"), cut.alias("cut_"))
    last = sliced.groupBy(group, "cut_", "key").agg(F.max("seq").alias("seq"))
    late = F.row_number().over(Window.partitionBy(group, "cut_").orderBy(F.desc("seq")))
    ends = last.withColumn("late_", late).where(F.col("late_") <= capacity)
    held = scan(ends, group, ["cut_", "seq"], ["cut_", "key"], held_before(capacity), f"cut_ {kind_of(sliced, 'cut_')}, place_ long, key {kind_of(sliced, 'key')}")
    replayed = sliced.withColumn("place_", F.lit(capacity).cast("long")).unionByName(held, allowMissingColumns=True)
    schema = f"place_ long, seq {kind_of(sliced, 'seq')}, key {kind_of(sliced, 'key')}, hit boolean"
    out = scan(replayed, [group, "cut_"], ["place_", "seq"], ["place_", "seq", "key"], replay(capacity), schema)
    return out.where(F.col("place_") == capacity).select(group, "seq", "key", "hit")


def held_before(capacity: int) -> Callable:
    """(slice, place, key): what a cache holds, oldest first, before the first access of each slice."""

    def start() -> tuple:
        held: OrderedDict = OrderedDict()
        at: list = []

        def step(cut, key):
            out = []
            if at != [cut]:
                out, at[:] = [(cut, i, k) for i, k in enumerate(held)], [cut]
            held[key] = None
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
            return out

        return step, lambda: []

    return start


def replay(capacity: int) -> Callable:
    """As ``lru``, with the place of each access kept."""

    def start() -> tuple:
        step, end = lru(capacity)()
        return lambda place, seq, key: [(place, *r) for r in step(seq, key)], end

    return start


class Segmented:
    """A cache of three segments with admission by frequency: new keys enter a small window; what falls out of it enters the
    probation segment if there is room or if it is asked for more often than the next victim; a hit on probation protects a key."""

    def __init__(self, capacity: int, width: int = 272, depth: int = 5):
        import xxhash

        window = max(1, capacity // 100)
        main = capacity - window
        probation = max(1, main // 5)
        self.size = {"window": window, "probation": probation, "protected": max(1, main - probation)}
        self.held: dict[str, OrderedDict] = {name: OrderedDict() for name in self.size}
        self.table = [[0] * width for _ in range(depth)]
        self.spots = lambda key: [xxhash.xxh3_64_intdigest(str(key), seed=r) % width for r in range(depth)]

    def note(self, key) -> None:
        for row, b in zip(self.table, self.spots(key), strict=True):
            row[b] += 1

    def often(self, key) -> int:
        return min(row[b] for row, b in zip(self.table, self.spots(key), strict=True))

    def _add(self, name: str, key):
        """Adds as most recent; returns what falls out."""
        held = self.held[name]
        held[key] = None
        held.move_to_end(key)
        return held.popitem(last=False)[0] if len(held) > self.size[name] else None

    def get(self, key) -> bool:
        self.note(key)
        for name in ("window", "protected"):
            if key in self.held[name]:
                self.held[name].move_to_end(key)
                return True
        if key in self.held["probation"]:
            del self.held["probation"][key]
            out = self._add("protected", key)
            if out is not None:
                self._add("probation", out)
            return True
        return False

    def put(self, key) -> None:
        self.note(key)
        for name in ("window", "protected", "probation"):
            if key in self.held[name]:
                self.held[name].move_to_end(key)
                return
        out = self._add("window", key)
        if out is None:
            return
        probation = self.held["probation"]
        if len(probation) >= self.size["probation"] and self.often(out) <= self.often(next(iter(probation))):
            return
        self._add("probation", out)


def segmented(capacity: int) -> Callable:
    """(seq, key, hit) of each access: a get, and a put where it missed."""

    def start() -> tuple:
        cache = Segmented(capacity)

        def step(seq, key):
            hit = cache.get(key)
            if not hit:
                cache.put(key)
            return [(seq, key, hit)]

        return step, lambda: []

    return start
