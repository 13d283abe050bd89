"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is hashed and sketched: register i holds the exponentially spaced, truncated minimum
of the i-th hash over the set, so sketches merge by maximum and equal registers tell of similar sets. Bands of registers
propose candidates, a joint likelihood estimate of the two sketches drops hopeless ones, and the full sets decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Hashes, arrow_rows, components, discard, documents, materialize, mix64, n_partitions, text_batches

#: 32 bands of 6 registers: at similarity 0.85 a pair is missed with probability 3e-7, at 0.8 with 6e-5.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Base, rate and largest register value of the sketch (16-bit registers for sets of up to about 1e25 elements).
B, A, Q = 1.001, 20.0, 65534
#: Members that one task compares with one representative.
FAN = 256
#: Members of a bucket's rest that one task holds, while as many times SLICE of the bucket's members stream by.
BLOCK, SLICE = 256, 4

_NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(text: str) -> list[str]:
    """Words of a text: runs without ASCII white space, A-Z lower-cased."""
    return _NOT_SPACE.findall(text.translate(_UPPER))


def shingle_sets(texts: list[str], hashes: Hashes, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; a shorter text is one shingle, one without words none."""
    lists = [words(t) for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.fromiter((hashes[w] for x in lists for w in x), dtype=np.uint64, count=int(counts.sum()))
    ends = np.cumsum(counts)
    n = len(flat)
    rolled = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        rolled += flat[k : k + len(rolled)] * _ODD[k]
    rolled = mix64(rolled)
    out = []
    for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if c >= size:
            out.append(np.unique(rolled[e - c : e - size + 1]))
        elif c:
            out.append(mix64(np.array([(flat[e - c : e] * np.array(_ODD[:c], dtype=np.uint64)).sum(dtype=np.uint64) + np.uint64(c)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """192 bits that equal sets share."""
    return np.array([s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64), len(s)], dtype=np.uint64).tobytes()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    low = np.empty((len(sets), REGISTERS), dtype=np.uint64)
    for begin, stop in _runs(starts, len(flat)):
        part = flat[starts[begin] : stop[1]]
        at = starts[begin : stop[0]] - starts[begin]
        for i in range(REGISTERS):
            h = part ^ _SEEDS[i]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
            low[begin : stop[0], i] = np.minimum.reduceat(h, at)
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(smallest) / np.log(B)), 0, Q + 1).astype(np.uint16)


def _runs(starts: np.ndarray, n: int, most: int = 32_768):
    """Cuts sets into runs that fit the processor's cache."""
    begin, ends = 0, np.append(starts[1:], n)
    while begin < len(starts):
        stop = max(begin + 1, int(np.searchsorted(ends, starts[begin] + most, side="right")))
        yield begin, (stop, int(ends[stop - 1]))
        begin = stop


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets with known sizes by the joint likelihood of their registers, as a maximum over a grid."""
    plus, minus = (x > y).sum(1), (x < y).sum(1)
    equal = x.shape[1] - plus - minus
    u, v = nx / (nx + ny), ny / (nx + ny)
    best, at = np.full(len(x), -np.inf), np.zeros(len(x))
    p = lambda z: -np.log1p(-z * (B - 1) / B) / np.log(B)
    for j in np.linspace(0, 1, 101):
        ok = (u - v * j >= -1e-12) & (v - u * j >= -1e-12)
        a, b = p(np.clip(u - v * j, 1e-9, 1)), p(np.clip(v - u * j, 1e-9, 1))
        like = plus * np.log(a) + minus * np.log(b) + equal * np.log(np.clip(1 - a - b, 1e-12, 1))
        better = ok & (like > best)
        best[better], at[better] = like[better], j
    return at


def _sketch_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    hashes = Hashes()
    for ids, texts in text_batches(batches, "doc_id", "text"):
        sets = shingle_sets(texts, hashes)
        full = [k for k, s in enumerate(sets) if len(s)]
        regs: list[bytes | None] = [None] * len(sets)
        print_: list[bytes | None] = [None] * len(sets)
        if full:
            for k, row in zip(full, sketches([sets[k] for k in full]), strict=True):
                regs[k], print_[k] = row.tobytes(), fingerprint(sets[k])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(print_, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "print", "sketch"])


def _band_rows(batches: Iterator) -> Iterator:
    """(class, size, band, key) for each band of each class."""
    import pyarrow as pa

    weights = mix64(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
    number = np.arange(BANDS, dtype=np.int16)
    each = lambda v: pa.array(np.repeat(np.array(v, dtype=np.int64), BANDS))
    for ids, sizes, docs, regs in arrow_rows(batches, "cid", "n", "doc", "sketch"):
        x = np.frombuffer(b"".join(regs), dtype=np.uint16).reshape(len(ids), BANDS, ROWS).astype(np.uint64)
        keys = mix64((x * weights).sum(2, dtype=np.uint64) + number.astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([each(ids), each(sizes), each(docs), pa.array(np.tile(number, len(ids))), pa.array(keys.ravel())], ["cid", "n", "doc", "band", "key"])


def _likely(threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for a, b, na, nb, x, y in arrow_rows(batches, "a", "b", "na", "nb", "x", "y"):
            x, y = (np.frombuffer(b"".join(z), dtype=np.uint16).reshape(len(a), REGISTERS) for z in (x, y))
            ok = estimate(x, y, np.array(na, dtype=float), np.array(nb, dtype=float)) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, dtype=np.int64)[ok]), pa.array(np.array(b, dtype=np.int64)[ok])], ["a", "b"])

    return run


def _confirm(percent: int):
    """Streams rows sorted by (hub, salt, role): the hub's set is held while its members pass by."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, held, hub_set = Hashes(), None, None
        for hubs, salts, ids, roles, prints, texts in text_batches(batches, "hub", "salt", "id", "role", "print", "text"):
            sets = shingle_sets(texts, hashes)
            links: tuple[list, list] = ([], [])
            for hub, salt, one, role, known, s in zip(hubs, salts, ids, roles, prints, sets, strict=True):
                if fingerprint(s) != known:
                    continue  # another text under the same doc_id
                if role == 0:
                    held, hub_set = (hub, salt), s
                elif held == (hub, salt):
                    both = len(np.intersect1d(hub_set, s, assume_unique=True))
                    if 100 * both >= percent * (len(hub_set) + len(s) - both):
                        links[0].append(hub)
                        links[1].append(one)
            yield pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])

    return run


def _set_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    hashes = Hashes()
    for ids, prints, texts in text_batches(batches, "cid", "print", "text"):
        sets = shingle_sets(texts, hashes)
        ok = [k for k, s in enumerate(sets) if fingerprint(s) == prints[k]]  # else another text under the same doc_id
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in ok], pa.int64()), pa.array([sets[k].tobytes() for k in ok], pa.binary())], ["cid", "elements"])


def _compare_rest(percent: int):
    """Streams rows sorted by (band, key, block, slice, role): a block of a bucket's rest is held while a slice of the bucket passes by.

    Pairs are compared in the first band that they share, by sketches and then by whole sets; links within a tree that the
    task already has are not needed and not emitted.
    """
    share = percent / 100
    least = REGISTERS * share - 5.5 * np.sqrt(REGISTERS * share * (1 - share))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, held, parent = None, [], {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def against(band: int, chunk: list[tuple]) -> Iterator[tuple[int, int]]:
            """Rows are (cid, component, main, registers, elements)."""
            regs = np.stack([h[3] for h in held])
            sizes = np.array([len(h[4]) // 8 for h in held])
            for cid, component, main, row, packed in chunk:
                n, elements = len(packed) // 8, None
                equal = regs == row
                ok = (equal.sum(1) >= least) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                for k in np.flatnonzero(ok).tolist():
                    a, ca, _, _, other = held[k]
                    if ca == component or (component != main and a >= cid) or root(ca) == root(component):
                        continue
                    if int(np.argmax(equal[k].reshape(BANDS, ROWS).all(1))) != band:
                        continue
                    if elements is None:
                        elements = np.frombuffer(packed, dtype=np.uint64)
                    both = len(np.intersect1d(np.frombuffer(other, dtype=np.uint64), elements, assume_unique=True))
                    if 100 * both >= percent * (len(other) // 8 + n - both):
                        parent[root(ca)] = root(component)
                        yield a, cid

        names = ("band", "key", "block", "slice", "role", "cid", "component", "main", "sketch", "elements")
        for cols in arrow_rows(batches, *names):
            out: list[tuple[int, int]] = []
            chunk: list[tuple] = []
            for band, key, block, slice_, role, cid, component, main, regs, elements in zip(*cols, strict=True):
                if at != (band, key, block, slice_):
                    if chunk and held:
                        out += against(at[0], chunk)
                    at, held, chunk = (band, key, block, slice_), [], []
                    parent.clear()
                row = (cid, component, main, np.frombuffer(regs, dtype=np.uint16), elements)
                (held if role == 0 else chunk).append(row)
            if chunk and held:
                out += against(at[0], chunk)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of five-word shingles; component_id is
    the smallest doc_id that links reach. Texts without words (null, empty, blank) have no shingles and no links. Rows with
    a null doc_id are linked as copies only and lend no id (component null if none of the copies has one); repeated rows are copies.
    An empty table gives no rows; further columns are ignored.

    Copies of a set become one class before anything is compared. In each band bucket, members are first compared with
    representatives only (the class of the smallest id in even bands, a band's own pseudo-random one in odd bands); links
    make components; then whatever lies in another component than most of its bucket is compared with all of the bucket, in tiles
    of a block of the one and a slice of the other. So no group is expanded into all of its pairs, yet every candidate pair ends in one component or is compared.
    Work beyond the input is in proportion to band rows (32 narrow rows a class) and to texts of candidates.
    """
    spark = docs.sparkSession
    texts = documents(docs)
    marked = materialize(texts.mapInArrow(_sketch_rows, "doc_id long, n_shingles long, print binary, sketch binary"), "near")
    classes = marked.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "near")  # numbers of classes, fixed once written
    live = classes.where("doc is not null")
    bands = materialize(live.select("cid", "n", "doc", "sketch").mapInArrow(_band_rows, "cid long, n long, doc long, band short, key long"), "near")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("c"), F.min_by("cid", F.struct("doc", "cid")).alias("first"), F.min_by("cid", F.xxhash64("cid", "band")).alias("any")).where("c > 1")
    buckets = materialize(bands.join(shared, ["band", "key"]).withColumn("hub", F.when(F.col("band") % 2 == 0, F.col("first")).otherwise(F.col("any"))).select("band", "key", "cid", "hub"), "near")
    discard(bands)

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among (a, b) pairs, b compared with a: sketches first, then whole texts."""
        sizes = live.select("cid", "n", "sketch")
        ends = pairs.join(sizes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), "a")
        ends = ends.join(sizes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
        ends = ends.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        likely = materialize(ends.mapInArrow(_likely(percent / 100 - 0.25), "a long, b long"), "near")
        likely_pairs.append(likely)
        fans = likely.groupBy("a").agg(F.ceil(F.count("*") / fan).alias("fan"))
        salted = likely.join(fans, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan")))
        hubs = salted.select(F.col("a").alias("hub"), "salt", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
        rows = hubs.union(salted.select(F.col("a").alias("hub"), "salt", F.col("b").alias("id"), F.lit(1).alias("role")))
        wanted = live.select(F.col("cid").alias("id"), "doc", "print").join(rows.select("id").distinct(), "id", "left_semi")
        found = texts.join(wanted, texts["doc_id"] == wanted["doc"]).select("id", "print", "text")
        dealt = rows.join(found, "id").repartition(n_partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt", "role")
        return dealt.select("hub", "salt", "id", "role", "print", "text").mapInArrow(_confirm(percent), "a long, b long")

    stars = buckets.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    likely_pairs: list[DataFrame] = []
    links = materialize(verify(stars), "near")
    for df in likely_pairs:
        discard(df)
    met = components(links)
    known = buckets.join(met, buckets["cid"] == met["id"], "left").select("band", "key", "cid", F.coalesce("component", "cid").alias("component"))
    known = materialize(known, "near")
    discard(buckets)
    discard(met)
    per = known.groupBy("band", "key", "component").agg(F.count("*").alias("c"))
    main = per.groupBy("band", "key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main"), (F.sum("c") - F.max("c")).alias("rest"), F.sum("c").alias("size")).where("parts > 1")
    tiles = main.select("band", "key", "main", F.ceil(F.col("rest") / block).cast("int").alias("blocks"), F.ceil(F.col("size") / (SLICE * block)).cast("int").alias("slices"))
    mixed = materialize(known.join(tiles, ["band", "key"]), "near")
    discard(known)
    wanted = live.select("cid", "doc", "print").join(mixed.select("cid").distinct(), "cid", "left_semi")
    found = texts.join(wanted, texts["doc_id"] == wanted["doc"]).select("cid", "print", "text")
    sets = materialize(found.mapInArrow(_set_rows, "cid long, elements binary").dropDuplicates(["cid"]).join(live.select("cid", "sketch"), "cid"), "near")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), n).cast("int")
    base = ["band", "key", "cid", "component", "main"]
    held = mixed.where("component <> main").select(*base, F.lit(0).alias("role"), part("blocks", 0).alias("block"), every("slices").alias("slice"))
    stream = mixed.select(*base, F.lit(1).alias("role"), every("blocks").alias("block"), part("slices", 1).alias("slice"))
    tile = ["band", "key", "block", "slice"]
    rows = held.union(stream).join(sets, "cid").repartition(n_partitions(spark), *tile).sortWithinPartitions(*tile, "role")
    more = materialize(rows.select(*base, "role", "block", "slice", "elements", "sketch").mapInArrow(_compare_rest(percent), "a long, b long"), "near")
    ends = components(links.union(more))
    for df in (mixed, sets, links, more):
        discard(df)
    named = classes.select("print", "doc", "cid").join(ends, classes["cid"] == ends["id"], "left").withColumn("of", F.coalesce("component", "cid"))
    lows = named.where("component is not null").groupBy("of").agg(F.min("doc").alias("low"))
    firsts = named.join(lows, "of", "left").select("print", F.coalesce("low", "doc").alias("component_"))
    out = marked.select("doc_id", "n_shingles", "print").join(firsts, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs``, with all columns, with one document of each near-duplicate group: the one whose doc_id is its group's smallest.

    All rows with a null doc_id stay, as do texts without words; of rows that repeat a kept doc_id each stays; an empty table
    gives no rows.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def oracle(percent: int = 85) -> str:
    """The same rows by comparing all sets of documents that share a shingle."""
    return f"""
    with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
    s as (select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh from w),
    e as (select doc_id, unnest(sh) as g from s),
    n as (select doc_id, len(sh) as n from s),
    i as (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
    l as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= {percent} * (p.n + q.n - c)),
    r as (with recursive t as (select doc_id as x, doc_id as y from n union select t.x, case when l.a = t.y then l.b else l.a end from t join l on l.a = t.y or l.b = t.y) select x, min(y) as m from t group by x)
    select doc_id, n::bigint as n_shingles, m as component_id, doc_id = m as kept from n join r on r.x = n.doc_id"""
