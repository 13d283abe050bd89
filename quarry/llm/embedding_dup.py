"""Near-duplicate embeddings by NN-descent within labels.

Vectors that are equal become one class. Buckets of random-hyperplane codes, as many tables of them as miss a pair at the
threshold with probability 1e-6, seed a neighbour graph, which is refined by joining the neighbours of each vector with one another;
lists that are full of links are enlarged. Every link that is met on the way is kept, whatever the lists keep. Buckets too large
for one task are then compared as far as links have not joined them, links are counted exactly within components, and an audit
compares a sample with all vectors; if it finds a link that was lost, everything is done again with twice the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, components, discard, materialize, n_partitions

#: Vectors that one task compares with each other, or holds while at most FAN times as many stream by.
BLOCK, FAN = 1024, 4
#: Members of one vector's neighbourhood that are joined at a time; tables that seed neighbour lists.
JOIN, SEEDED = 64, 3
#: Chance that no table brings a pair at the threshold together, and vectors of one audit.
MISS, AUDITED = 1e-6, 256


def _unit_rows(batches: Iterator) -> Iterator:
    """(vec_id, label, raw, print): the vector's bytes and a digest of it normalized, or nulls where it may link with nothing."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        ids, vectors, labels = (b.column(b.schema.get_field_index(n)) for n in ("vec_id", "embedding", "label"))
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        known = sizes > 0
        for c in (ids, labels):
            known &= pc.is_valid(c).to_numpy(zero_copy_only=False)
        raws: list[bytes | None] = [None] * len(sizes)
        prints: list[bytes | None] = [None] * len(sizes)
        for n in np.unique(sizes[known]).tolist():
            at = np.flatnonzero(known & (sizes == n))
            raw = values[starts[at][:, None] + np.arange(n)[None, :]]
            ok = np.isfinite(raw).all(1) & (raw != 0).any(1)
            for i, row, unit in zip(at[ok].tolist(), raw[ok], _normal(raw[ok]), strict=True):
                raws[i], prints[i] = row.tobytes(), hashlib.md5(unit.tobytes()).digest()
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), labels.cast(pa.int64()), pa.array(raws, pa.binary()), pa.array(prints, pa.binary())], ["vec_id", "label", "raw", "print"])


def _normal(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    if len(x):
        x = x / np.abs(x).max(1, keepdims=True)
        x += 0.0  # no negative zeros: they would tell equal vectors apart
        x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def _matrix(rows: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    return _normal(np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1))


def _batch(kinds: dict[str, str], *columns):
    import pyarrow as pa

    types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if len(c) else [], types[t]) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _gathered(kinds: dict[str, str], parts: Iterator[tuple], most: int = 20_000) -> Iterator:
    """Few batches of many small ones."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield _batch(kinds, *zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield _batch(kinds, *zip(*held, strict=True))


EDGES = {"u": "long", "v": "long", "sim": "double"}


class _Forest:
    """Links that a task has not joined yet."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, c: int) -> int:
        root = self.root
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of these links join what was apart."""
        fresh = np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                fresh[k] = True
        return fresh


def _groups(batches: Iterator, keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys of a sorted stream."""
    at, rows = None, []
    for cols in arrow_rows(batches, *keys, *columns):
        for row in zip(*cols, strict=True):
            if row[: len(keys)] != at:
                if rows:
                    yield at, rows
                at, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield at, rows


def _join_groups(keys: tuple[str, ...], k: int, threshold: float, kind: str):
    """Within each group of rows all pairs are compared. Emitted: links that span what the group joins, and, where ``seeds`` says
    so, for each row its best ``k`` others that are better than ``worst``, what its list has last."""

    def pairs(batches: Iterator) -> Iterator:
        for _, rows in _groups(batches, keys, ("cid", "raw", "worst", "seeds")):
            ids, raws, worst, seeds = zip(*rows, strict=True)
            name, low = np.array(ids), np.array(worst)
            name, first = np.unique(name, return_index=True)
            if len(name) < 2:
                continue
            x, low = _matrix([raws[i] for i in first], kind), low[first]
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            a, b = np.nonzero(np.triu(sims >= threshold))
            fresh = _Forest().join(name[a], name[b])
            a, b = a[fresh], b[fresh]
            yield name[a], name[b], sims[a, b]
            if seeds[0] and k:
                n = min(k, len(name) - 1)
                top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                a = np.repeat(np.arange(len(name)), n)
                b = top.ravel()
                better = sims[a, b] > low[a]
                a, b = a[better], b[better]
                yield name[a], name[b], sims[a, b]

    return lambda batches: _gathered(EDGES, pairs(batches))


def _codes(tables: int, bits: int, kind: str, seed: int = 17):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for ids, labels, raws in arrow_rows(batches, "cid", "label", "raw"):
            by_dim: dict[int, list[int]] = {}
            for k, u in enumerate(raws):
                by_dim.setdefault(len(u) // np.dtype(kind).itemsize, []).append(k)
            for dim, at in by_dim.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed + dim).normal(size=(dim, tables * max(bits, 1)))
                signs = (_matrix([raws[k] for k in at], kind) @ planes[dim] > 0).reshape(len(at), tables, -1)
                codes = (signs * (1 << np.arange(signs.shape[2], dtype=np.int64))).sum(2) * (bits > 0) + dim * (1 << 40)
                pick = lambda v, at=at: np.repeat(np.array([v[k] for k in at], dtype=np.int64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(pick(ids)), pa.array(pick(labels)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(codes.ravel())], ["cid", "label", "table", "code"])

    return run


def tiled(held: DataFrame, stream: DataFrame, keys: list[str], n_held: str, n_stream: str, block: int) -> DataFrame:
    """Rows of both sides dealt into tiles, sorted with held rows (role 0) first: a tile has about ``block`` held rows of a group
    and FAN times as many of those that stream by, so neither side of a large group meets in one task."""
    blocks, slices = F.ceil(F.col(n_held) / block).cast("int"), F.ceil(F.col(n_stream) / (FAN * block)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = held.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("slice", every(slices)).withColumn("role", F.lit(0))
    rows = rows.unionByName(stream.withColumn("slice", F.pmod(F.xxhash64("cid", F.lit(1)), slices).cast("int")).withColumn("block", every(blocks)).withColumn("role", F.lit(1)))
    order = [*keys, "block", "slice"]
    return rows.repartition(n_partitions(held.sparkSession), *order).sortWithinPartitions(*order, "role").drop(n_held, n_stream)


def _count(threshold: float, kind: str):
    """Tiles of held rows, which lie outside of the core of their component (see ``near_duplicates``), and of all its rows.

    Emits (cid, n): for every streamed row the weight of held rows that it links with, and for held rows the weight of core rows
    that they link with; a row itself does not count.
    """
    keys = ("component", "block", "slice")

    def counts(batches: Iterator) -> Iterator:
        for _, rows in _groups(batches, keys, ("role", "cid", "raw", "w", "core")):
            held, chunk = [r[1:] for r in rows if not r[0]], [r[1:] for r in rows if r[0]]
            if not held or not chunk:
                continue
            (hi, hr, hw, _), (ci, cr, cw, core) = zip(*held, strict=True), zip(*chunk, strict=True)
            hi, hw, ci, cw, core = (np.array(v) for v in (hi, hw, ci, cw, core))
            link = (_matrix(list(cr), kind) @ _matrix(list(hr), kind).T) >= threshold
            link &= ci[:, None] != hi[None, :]
            yield np.concatenate([ci, hi]), np.concatenate([(link * hw[None, :]).sum(1), ((link & core[:, None]) * cw[:, None]).sum(0)])

    return lambda batches: _gathered({"cid": "long", "n": "long"}, counts(batches))


def _rest(keys: tuple[str, ...], threshold: float, kind: str):
    """Tiles of rows that their bucket's largest component leaves out and of all rows of the bucket: links that join components."""

    def joins(batches: Iterator) -> Iterator:
        for _, rows in _groups(batches, (*keys, "block", "slice"), ("role", "raw", "comp")):
            held, chunk = [r[1:] for r in rows if not r[0]], [r[1:] for r in rows if r[0]]
            if not held or not chunk:
                continue
            (hr, hc), (cr, cc) = zip(*held, strict=True), zip(*chunk, strict=True)
            hc, cc = np.array(hc), np.array(cc)
            i, j = np.nonzero((_matrix(list(cr), kind) @ _matrix(list(hr), kind).T >= threshold) & (cc[:, None] != hc[None, :]))
            pairs = np.unique(np.stack([cc[i], hc[j]], 1), axis=0)
            pairs = pairs[_Forest().join(pairs[:, 0], pairs[:, 1])]
            yield pairs[:, 0], pairs[:, 1]

    return lambda batches: _gathered({"a": "long", "b": "long"}, joins(batches))


def missed(classes: DataFrame, component: DataFrame, threshold: float, kind: str, queries: int = AUDITED) -> tuple[int, int]:
    """Links of ``queries`` vectors, taken by hash, with all vectors: how many there are, and how many of them join different components.

    One pass over narrow rows; the queries (a constant number) are sent to all tasks.
    """
    spark = classes.sparkSession
    rows = classes.select("cid", "label", "raw").join(component.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    asked = rows.orderBy(F.xxhash64("cid", F.lit(5)), "cid").limit(queries).collect()
    if not asked:
        return 0, 0
    sent = spark.sparkContext.broadcast([tuple(r) for r in asked])

    def run(batches: Iterator) -> Iterator:
        by_dim: dict[int, list[tuple]] = {}
        for q in sent.value:
            by_dim.setdefault(len(q[2]), []).append(q)
        held = {n: (np.array([q[0] for q in qs]), np.array([q[1] for q in qs]), _matrix([q[2] for q in qs], kind), np.array([q[3] for q in qs])) for n, qs in by_dim.items()}
        total = lost = 0
        for cols in arrow_rows(batches, "cid", "label", "raw", "component"):
            own: dict[int, list[int]] = {}
            for k, u in enumerate(cols[2]):
                own.setdefault(len(u), []).append(k)
            for n, at in own.items():
                if n in held:
                    ids, labels, x, comps = held[n]
                    cid, label, comp = (np.array([cols[c][k] for k in at]) for c in (0, 1, 3))
                    link = (_matrix([cols[2][k] for k in at], kind) @ x.T >= threshold) & (label[:, None] == labels[None, :]) & (cid[:, None] != ids[None, :])
                    total += int(link.sum())
                    lost += int((link & (comp[:, None] != comps[None, :])).sum())
        yield _batch({"n": "long", "lost": "long"}, [[total]], [[lost]])

    r = rows.mapInArrow(run, "n long, lost long").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).first()
    return r["n"] or 0, r["lost"] or 0


def linked(classes: DataFrame, biggest: int, threshold: float, k: int, tables: int, bits: int, rounds: int, block: int, kind: str) -> DataFrame:
    """(id, component) of all classes that a link was found for."""
    parts = n_partitions(classes.sparkSession)
    raw = classes.select("cid", "raw")
    keys = ("table", "label", "code")
    coded = materialize(classes.select("cid", "label", "raw").mapInArrow(_codes(tables, bits, kind), "cid long, label long, table int, code long"), "vec")
    buckets = materialize(coded.groupBy(*keys).agg(F.count("*").alias("m"), F.min_by("cid", F.xxhash64("cid", "table")).alias("hub")).where("m > 1"), "vec")
    split = F.ceil(F.col("m") / block).cast("int")
    dealt = coded.join(buckets, [*keys]).withColumn("part", F.pmod(F.xxhash64("cid", "table"), split))
    hubs = buckets.where(F.col("m") > block).select(*keys, F.col("hub").alias("cid"), F.explode(F.sequence(F.lit(0), split - 1).cast("array<bigint>")).alias("part"))
    dealt = dealt.select(*keys, "cid", "part").unionByName(hubs)
    order = [*keys, "part"]
    dealt = dealt.join(raw, "cid").withColumn("worst", F.lit(-2.0)).withColumn("seeds", F.col("table") < SEEDED)
    dealt = dealt.repartition(parts, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{n} {t}" for n, t in EDGES.items())
    edges = materialize(dealt.mapInArrow(_join_groups(tuple(order), k, threshold, kind), schema), "vec")
    links = [edges.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))]

    def trimmed(found: DataFrame) -> DataFrame:
        """The best ``k`` neighbours of each vector, four times as many where the list is full of links; ``worst``: its last."""
        both = found.select("u", "v", "sim").union(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).groupBy("u", "v").agg(F.max("sim").alias("sim"))
        ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
        full = F.max(F.when((F.col("r") == k) & (F.col("sim") >= threshold), F.lit(4 * k)).otherwise(F.lit(k))).over(Window.partitionBy("u"))
        kept = ranked.withColumn("most", full).where("r <= most")
        return kept.withColumn("worst", F.when(F.count("*").over(Window.partitionBy("u")) < F.col("most"), F.lit(-2.0)).otherwise(F.min("sim").over(Window.partitionBy("u")))).select("u", "v", "sim", "worst")

    old = [edges]
    graph = materialize(trimmed(edges), "vec") if rounds else None
    size = graph.count() if rounds else 0
    for _ in range(rounds if size else 0):
        own = graph.groupBy("u").agg(F.first("worst").alias("worst"))
        lists = graph.select(F.col("u").alias("center"), F.col("v").alias("cid")).union(graph.select(F.col("v").alias("center"), F.col("u").alias("cid"))).union(own.select(F.col("u").alias("center"), F.col("u").alias("cid"))).distinct()
        sizes = lists.groupBy("center").agg(F.ceil(F.count("*") / JOIN).cast("int").alias("parts"))
        lists = lists.join(sizes, "center").withColumn("part", F.pmod(F.xxhash64("cid", "center"), F.col("parts")))
        lists = lists.join(own.select(F.col("u").alias("cid"), "worst"), "cid").join(raw, "cid").withColumn("seeds", F.lit(True))
        lists = lists.select("center", "part", "cid", "raw", "worst", "seeds").repartition(parts, "center", "part").sortWithinPartitions("center", "part")
        found = materialize(lists.mapInArrow(_join_groups(("center", "part"), k, threshold, kind), schema).dropDuplicates(["u", "v"]), "vec")
        links.append(found.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
        after = materialize(trimmed(graph.select("u", "v", "sim").union(found)), "vec")
        fresh = after.join(graph, ["u", "v"], "left_anti").count()
        discard(graph)
        old.append(found)
        graph = after
        if fresh <= 0.01 * size:
            break
        size = after.count()
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    met = materialize(components(every), "vec")

    if biggest > block:  # else no bucket was split
        large = buckets.where(F.col("m") > block).select(*keys)
        member = coded.join(large, [*keys]).join(met.select(F.col("id").alias("cid"), "component"), "cid", "left").select(*keys, "cid", F.coalesce("component", "cid").alias("comp"))
        member = materialize(member, "vec")
        per = member.groupBy(*keys, "comp").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("n_stream"), (F.sum("c") - F.max("c")).alias("n_held")).where("n_held > 0")
        whole = member.join(per, [*keys]).join(raw, "cid")
        rows = tiled(whole.where("comp <> main").drop("main"), whole.drop("main"), [*keys], "n_held", "n_stream", block)
        joins = materialize(rows.mapInArrow(_rest(keys, threshold, kind), "a long, b long"), "vec")
        if not joins.isEmpty():
            after = materialize(components(every.union(joins)), "vec")
            discard(met)
            met = after
        for df in (member, joins):
            discard(df)
    for df in (coded, buckets, graph, *old):
        if df is not None:
            discard(df)
    return met


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = 8, rounds: int = 2, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Rows link if their labels are equal and the cosine in double precision is at least ``threshold``. A row with a null id, a
    null label or a vector that is null, empty, zero, or holds a null or non-finite component has no links (component_id its own
    id); vectors of different dimensions do not link; repeated rows and equal vectors are copies that link with each other; an
    empty table gives no rows; further columns are ignored.

    Neighbour lists have at most ``k`` entries (four times as many where all of them are links) and only lead the way; links are
    never trimmed. A bucket of up to ``block`` vectors is compared whole; a larger one in parts, each with the bucket's hub, and then
    whatever lies outside of its largest component with all of it, in tiles. So a pair is lost only if no table brings it
    together (probability ``miss`` at the threshold, less above) and no neighbour leads to it. Inside a component, members within half the
    threshold angle of one pivot all link (no comparison needed); others are compared in tiles, and only counts leave the task.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    values = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = materialize(src.mapInArrow(_unit_rows, "vec_id long, label long, raw binary, print binary"), "vec")
    classes = rows.where("print is not null").groupBy("label", "print").agg(F.min("vec_id").alias("cid"), F.count("*").alias("w"), F.min("raw").alias("raw"))
    classes = materialize(classes, "vec")
    biggest = classes.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bits = max(0, min(30, math.ceil(math.log2(max(biggest, 1) / block)) + 1)) if biggest > block else 0
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log(1 - same))) if same < 1 else 1
    while True:
        links = linked(classes, biggest, threshold, k, tables, bits, rounds, block, kind)
        if not bits or not missed(classes, links, threshold, kind)[1]:
            break
        discard(links)
        tables *= 2

    # exact counts inside components
    half = math.cos(math.acos(min(1.0, threshold)) / 2 - 1e-6)
    member = classes.join(links, classes["cid"] == links["id"]).select("component", "cid", "raw", "w")
    pivots = member.where("cid = component").select("component", F.col("raw").alias("pivot"))

    def near_pivot(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for comp, cid, raws, w, pivot in arrow_rows(batches, "component", "cid", "raw", "w", "pivot"):
            core = [bool(_matrix([u], kind)[0] @ _matrix([p], kind)[0] >= half) for u, p in zip(raws, pivot, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(comp, pa.int64()), pa.array(cid, pa.int64()), pa.array(raws, pa.binary()), pa.array(w, pa.int64()), pa.array(core)], ["component", "cid", "raw", "w", "core"])

    member = materialize(member.join(pivots, "component").mapInArrow(near_pivot, "component long, cid long, raw binary, w long, core boolean"), "vec")
    sizes = member.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("w")).otherwise(0)).alias("core_w"), F.sum((~F.col("core")).cast("long")).alias("n_held"), F.count("*").alias("n_stream"))
    sized = member.join(sizes, "component")
    base = sized.select("cid", F.when(F.col("core"), F.col("core_w") - F.col("w")).otherwise(F.lit(0)).alias("n"))
    cols = ["component", "cid", "raw", "w", "core", "n_held", "n_stream"]
    ordered = tiled(sized.where("not core").select(*cols), sized.where("n_held > 0").select(*cols), ["component"], "n_held", "n_stream", block)
    counted = base.union(ordered.mapInArrow(_count(threshold, kind), "cid long, n long")).groupBy("cid").agg(F.sum("n").alias("n"))
    result = classes.select("label", "print", "cid", "w").join(links.select(F.col("id").alias("cid"), "component"), "cid", "left").join(counted, "cid", "left")
    result = result.select("label", "print", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), F.coalesce("component", "cid").alias("component_"))
    out = rows.select("vec_id", "label", "print").join(result, ["label", "print"], "left")
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component_"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle(threshold: float = 0.93) -> str:
    """The same rows by comparing all pairs within labels."""
    return f"""
    with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
    g as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as m from e where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
    l as (select p.vec_id as a, q.vec_id as b from g p join g q on p.label = q.label and p.vec_id <> q.vec_id and len(p.v) = len(q.v) where list_dot_product(p.v, q.v) / (p.m * q.m) >= {threshold}),
    c as (with recursive t as (select vec_id as x, vec_id as y from e union select t.x, l.b from t join l on l.a = t.y) select x, min(y) as m from t group by x)
    select vec_id, (select count(*) from l where l.a = e.vec_id)::bigint as n_links, c.m as component_id, vec_id = c.m as kept from e join c on c.x = e.vec_id"""
