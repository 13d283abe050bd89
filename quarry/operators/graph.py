"""Graph analytics over ``edges(src, dst[, weight])`` by rounds of joins and aggregations.

A round reads the state of the round before from a written table, so lineage stays short and a lost executor costs a
re-read. Edges are bucketed by their source once: no round shuffles them again. Only counts and differences reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.session import discard, settle, shared_dir


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by ``key``, dropped afterwards; what is returned to callers must not read it."""
    spark = df.sparkSession
    name = f"quarry_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def _settled(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """Writes one round and returns its table and figures, which are observed while it is written."""
    seen = Observation()
    out = settle(df.observe(seen, *[c.alias(n) for n, c in figures.items()]), "graph")
    return out, seen.get


class _Gathered:
    """What the rounds of a loop find for good: a folder a round, read together as one table however many rounds there were."""

    def __init__(self, spark: SparkSession, schema) -> None:
        self.spark, self.schema, self.rounds = spark, schema, 0
        self.path = f"{shared_dir(spark)}/settled/gathered-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Writes what a round found; its table and its number of rows."""
        at, seen = f"{self.path}/round={self.rounds}", Observation()
        df.observe(seen, F.count("*").alias("n")).write.parquet(at)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(at), seen.get["n"]

    def all(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round=*")


class _Rounds:
    """The state of a loop: each round is written, and then the round before is deleted."""

    def __init__(self) -> None:
        self.last: DataFrame | None = None

    def step(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        out, seen = _settled(df, **figures)
        discard(self.last)
        self.last = out
        return out, seen


def build(edges: DataFrame) -> DataFrame:
    """(id): vertices are the ends of edges."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = vertices.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("n"))
    v = n.select("n").scalar()
    return e.select(v.alias("n_vertices"), F.col("n").alias("n_edges"), F.round(F.try_divide(F.col("n"), v * (v - 1)), 9).alias("density"))


def reverse(vertices: DataFrame, edges: DataFrame, part: int = 1000) -> DataFrame:
    """(id, part, n_in, sources): who links to each vertex; vertices without links stay, with part 0.

    A list holds the sources of one range of ``part`` ids, so that those of a hot vertex are many rows, made by many tasks.
    """
    ins = edges.groupBy(F.col("dst").alias("id"), F.floor(F.col("src") / part).alias("part")).agg(F.array_sort(F.collect_list("src")).alias("sources"))
    out = vertices.join(ins, "id", "left")
    return out.select("id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("n_in"), "sources")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, norm: str = "max", most: int = 100, seeds: list[int] | None = None, redistribute: bool = False) -> tuple[DataFrame, list[float]]:
    """(id, rank), and the difference of each round.

    Stops when the largest (``max``) or the summed (``l1``) change is below ``tolerance``. With ``seeds`` rank returns to
    these only, and is scaled to sum 1 at the end. Vertices without links lose their rank unless it is redistributed.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank")), []
    home = F.lit(1.0 / n)
    if seeds is not None:
        known = sorted(r["id"] for r in vertices.where(F.col("id").isin(list(set(seeds)))).collect())
        known = known or [vertices.agg(F.min("id").alias("id")).first()["id"]]
        home = F.when(F.col("id").isin(known), 1.0 / len(known)).otherwise(0.0)
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    history: list[float] = []
    with bucketed(edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("share")), "src") as links:
        base = settle(vertices.join(degree.select(F.col("src").alias("id"), "degree"), "id", "left").select("id", home.alias("home"), F.col("degree").isNull().alias("loose")))
        state = base.withColumn("rank", F.col("home") if seeds is not None else F.lit(1.0 / n))
        rounds = _Rounds()
        for _ in range(most):
            lost = state.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0)).alias("x")).first()["x"] if redistribute else 0.0
            inflow = links.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
            new = F.col("home") * (1 - damping) + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("home") * lost)
            step = state.join(inflow, "id", "left").select("id", "home", "loose", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
            state, seen = rounds.step(step, change=F.max("change") if norm == "max" else F.sum("change"))
            state = state.drop("change")
            history.append(seen["change"])
            if history[-1] < tolerance:
                break
    if seeds is not None:
        total = state.agg(F.sum("rank").alias("s")).first()["s"] or 1.0
        state = state.withColumn("rank", F.col("rank") / total)
    return state.select("id", "rank"), history


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``chosen(id)``."""
    return edges.join(chosen.select(F.col("id").alias("src")), "src", "left_semi").join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def distances(edges: DataFrame, source: int, weight: str | None = "weight", most: int | None = None) -> tuple[DataFrame, bool]:
    """(id, distance, hops) of vertices that ``source`` reaches, and whether a negative cycle was met.

    Each round relaxes the edges of vertices that the last one has improved, until none is. Without ``weight`` edges count one.
    Weights may be zero or negative; ``hops`` is the least number of edges of a shortest path where all are positive.
    """
    spark = edges.sparkSession
    kind = "double" if weight else "long"
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("long")
    state = spark.createDataFrame([(source, 0)], "id long, distance long").select("id", F.col("distance").cast(kind).alias("distance"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("fresh"))
    limit = most
    with bucketed(edges.select("src", "dst", w.alias("w")), "src") as links:
        n, states = 0, _Rounds()
        while True:
            reached = links.join(state.where("fresh").select(F.col("id").alias("src"), "distance", "hops"), "src")
            offers = reached.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("distance"), (F.col("hops") + 1).alias("hops"))).alias("offer"))
            better = F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer.distance") < F.col("distance")))
            step = state.drop("fresh").join(offers, "id", "full_outer").select("id", F.when(better, F.col("offer.distance")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("offer.hops")).otherwise(F.col("hops")).alias("hops"), better.alias("fresh"))
            state, seen = states.step(step, fresh=F.count_if("fresh"), n=F.count("*"))
            n += 1
            if not seen["fresh"]:
                return state.drop("fresh"), False
            if limit is not None and n >= limit:
                return state.drop("fresh"), False
            if n > seen["n"]:
                return state.drop("fresh"), True


def predecessors(edges: DataFrame, dist: DataFrame, weight: str = "weight") -> DataFrame:
    """(id, distance, predecessor): of the vertices before it on a shortest path the smallest; null at the source."""
    near = edges.join(dist.select(F.col("id").alias("src"), F.col("distance").alias("d")), "src")
    tight = near.join(dist.select(F.col("id").alias("dst"), F.col("distance").alias("e")), "dst").where(F.col("d") + F.col(weight) == F.col("e"))
    return dist.join(tight.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("predecessor")), "id", "left").select("id", "distance", "predecessor")


def best_paths(edges: DataFrame, sources: DataFrame, weight: str = "weight") -> DataFrame:
    """(origin, id, distance, path) from every row of ``sources(origin)`` to all that it reaches, by rounds of improvements; of equally
    short paths the one that is first in order. Weights are positive."""
    start = sources.select("origin", F.col("origin").alias("id"), F.struct(F.lit(0.0).alias("distance"), F.array("origin").alias("path")).alias("best"), F.lit(True).alias("fresh"))
    state = settle(start)
    with bucketed(edges.select("src", "dst", F.col(weight).cast("double").alias("w")), "src") as links:
        rounds = _Rounds()
        while True:
            reached = links.join(state.where("fresh").select("origin", F.col("id").alias("src"), "best"), "src")
            offer = F.struct((F.col("best.distance") + F.col("w")).alias("distance"), F.concat("best.path", F.array("dst")).alias("path"))
            offers = reached.select("origin", F.col("dst").alias("id"), offer.alias("offer")).groupBy("origin", "id").agg(F.min("offer").alias("offer"))
            better = F.col("offer").isNotNull() & (F.col("best").isNull() | (F.col("offer") < F.col("best")))
            step = state.drop("fresh").join(offers, ["origin", "id"], "full_outer").select("origin", "id", F.when(better, F.col("offer")).otherwise(F.col("best")).alias("best"), better.alias("fresh"))
            state, seen = rounds.step(step, fresh=F.count_if("fresh"))
            if not seen["fresh"]:
                return state.select("origin", "id", "best.distance", "best.path")


def _spread(links: DataFrame, labels: DataFrame, largest: bool = True) -> DataFrame:
    """Labels that reach each vertex along edges: the largest (or smallest), by rounds until nothing changes."""
    agg, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    state = labels.select("id", "label", F.lit(True).alias("fresh"))
    rounds = _Rounds()
    while True:
        offers = links.join(state.where("fresh").select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(agg("label").alias("offer"))
        new = F.coalesce(pick("label", "offer"), F.col("label"))
        step = state.drop("fresh").join(offers, "id", "left").select("id", new.alias("label"), (new != F.col("label")).alias("fresh"))
        state, seen = rounds.step(step, fresh=F.count_if("fresh"))
        if not seen["fresh"]:
            return state.select("id", "label")


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the component being its smallest vertex.

    Vertices without incoming or outgoing edges are components of their own and are trimmed first. Then the largest id that
    reaches each vertex colours it; within a colour, those that reach the colour's vertex in turn are its component. All colours are
    worked on at once, and what is left goes round again.
    """
    left, links = settle(vertices.select("id")), settle(edges.where("src <> dst").select("src", "dst").distinct())
    found, lefts, rests = _Gathered(vertices.sparkSession, "id long, root long"), _Rounds(), _Rounds()
    while True:
        while True:  # trim
            ends = links.select(F.col("src").alias("id")).distinct().join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            single, n = found.add(left.join(ends, "id", "left_anti").select("id", F.col("id").alias("root")))
            if not n:
                break
            left, _ = lefts.step(left.join(single, "id", "left_anti"), n=F.count("*"))
            links, _ = rests.step(induced(links, left), n=F.count("*"))
        if not left.take(1):
            break
        colour = _spread(links, left.select("id", F.col("id").alias("label")))
        own = links.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = settle(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        mark = _spread(back, colour.select("id", F.when(F.col("id") == F.col("label"), F.col("id")).otherwise(F.lit(-1)).alias("label")))
        done, _ = found.add(mark.where("label >= 0").select("id", F.col("label").alias("root")))
        discard(back)
        left, _ = lefts.step(left.join(done, "id", "left_anti"), n=F.count("*"))
        links, _ = rests.step(induced(links, left), n=F.count("*"))
    out = found.all()
    names = out.groupBy("root").agg(F.min("id").alias("component"))
    return out.join(names, "root").select("id", "component")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected parts by their smallest vertex.

    Every vertex hangs below the smallest one that it has met; a round joins neighbours' roots and then jumps to the root's root,
    so the number of rounds grows with the logarithm of the diameter.
    """
    both = settle(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct())
    state = settle(vertices.select("id", F.col("id").alias("root")))
    while True:
        roots = state.select(F.col("id").alias("src"), "root")
        met = both.join(roots, "src").groupBy(F.col("dst").alias("id")).agg(F.min("root").alias("met"))
        low = state.join(met, "id", "left").select("id", "root", F.least("root", F.coalesce("met", F.col("root"))).alias("low"))
        # a root takes the smallest root that any of its members has met
        hooks = low.groupBy("root").agg(F.min("low").alias("hook"))
        hooked = low.join(hooks, "root").select("id", F.col("root").alias("was"), F.col("hook").alias("root"))
        hooked = settle(hooked, "graph")
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = hooked.join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("was")).alias("fresh"))
        state, seen = _settled(step, fresh=F.count_if("fresh"))
        state = state.select("id", "root")
        if not seen["fresh"]:
            return state.select("id", F.col("root").alias("component"))


def topological_levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the layer in which a vertex loses its last incoming edge; null on a cycle or behind one."""
    left, links = settle(vertices.select("id")), settle(edges.select("src", "dst").distinct())
    found, lefts, rests = _Gathered(vertices.sparkSession, f"id {vertices.schema['id'].dataType.simpleString()}, level long"), _Rounds(), _Rounds()
    while True:
        free, n = found.add(left.join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(found.rounds).cast("long").alias("level")))
        if not n:
            return found.all().unionByName(left.select("id", F.lit(None).cast("long").alias("level")))
        left, _ = lefts.step(left.join(free, "id", "left_anti"), n=F.count("*"))
        links, _ = rests.step(links.join(free.select(F.col("id").alias("src")), "src", "left_anti"), n=F.count("*"))


def longest_paths(edges: DataFrame, weights: DataFrame, source: int) -> DataFrame:
    """(id, total) in an acyclic graph: the largest sum of vertex weights on a path from ``source``, whose own weight does not count."""
    spark = edges.sparkSession
    state = spark.createDataFrame([(source, 0.0, True)], "id long, total double, fresh boolean")
    with bucketed(edges.join(weights.select(F.col("id").alias("dst"), "weight"), "dst").select("src", "dst", F.col("weight").cast("double").alias("w")), "src") as links:
        rounds = _Rounds()
        while True:
            offers = links.join(state.where("fresh").select(F.col("id").alias("src"), "total"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("total") + F.col("w")).alias("offer"))
            better = F.col("offer").isNotNull() & (F.col("total").isNull() | (F.col("offer") > F.col("total")))
            state, seen = rounds.step(state.drop("fresh").join(offers, "id", "full_outer").select("id", F.when(better, F.col("offer")).otherwise(F.col("total")).alias("total"), better.alias("fresh")), fresh=F.count_if("fresh"))
            if not seen["fresh"]:
                return state.select("id", "total")


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, weight) of the minimum spanning forest; equal weights are ordered by ends, so it is unique.

    Each round every part takes its least outgoing edge and parts merge: at most log2(vertices) rounds.
    """
    e = settle(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("weight").alias("weight")))
    state, chosen = settle(vertices.select("id", F.col("id").alias("component"))), _Gathered(vertices.sparkSession, e.select("u", "v", "weight").schema)
    while True:
        a, b = state.select(F.col("id").alias("u"), F.col("component").alias("cu")), state.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        e = settle(e.join(a, "u").join(b, "v").where("cu <> cv"))
        whole = F.struct("weight", "u", "v")
        least = e.select(F.col("cu").alias("c"), whole.alias("e")).union(e.select(F.col("cv"), whole)).groupBy("c").agg(F.min("e").alias("e"))
        picked, n = chosen.add(least.select("e.*").select("u", "v", "weight").distinct())
        if not n:
            return chosen.all()
        merged = e.join(picked.select("u", "v"), ["u", "v"], "left_semi").select(F.col("cu").alias("src"), F.col("cv").alias("dst"))
        names = components(state.select(F.col("component").alias("id")).distinct(), merged)
        state = settle(state.join(names.select(F.col("id").alias("component"), F.col("component").alias("name")), "component").select("id", F.col("name").alias("component")))
        e = e.select("u", "v", "weight")
