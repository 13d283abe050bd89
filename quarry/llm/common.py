"""What the operators of this subpackage share: the scratch folder, batches, fingerprints and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Characters of texts that an operator handles at a time: batches are cut there, as texts may be very long.
BATCH_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of our own only in local mode, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: lineage ends there, so a lost executor costs a re-read.

    The shuffle files of the write are removed when it ends, not when the driver collects garbage: nothing reads them any more.
    With ``batch_bytes``, Spark hands rows to Python functions in batches of about so many bytes (a larger row is a batch of its
    own). Settings hold for the write only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    held = {CLEAN_SHUFFLES: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        jvm, hconf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hconf).delete(at, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that further columns of any name cannot clash; a null text is empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective, good avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of strings, the same in every process; bounded, as it only saves time."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self._hash, self._most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self._most:
            self.clear()
        h = self[word] = self._hash(word.encode("utf-8", "surrogatepass"))
        return h


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)`` (any sortable id type): one row ``(id, component)`` for each id that has a
    link, the component being its smallest id.

    Alternating large-star and small-star rounds; each is two shuffles of (id, id) rows, partly aggregated before the
    shuffle, and is written to the shared folder. Hubs are no single group: minima are aggregates, and a hub's rows are
    spread by the join that Spark can split. Stops when a round changes nothing. Nulls and self-links are ignored.
    """
    spark = links.sparkSession
    ends = links.select("a", "b").where("a is not null and b is not null")
    edges = materialize(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e
        lows = both.groupBy("a").agg(F.min("b").alias("m"))
        lows = lows.select("a", F.least("a", "m").alias("m"))
        out = both.join(lows, "a").where(F.col("b") > F.col("a") if large else F.lit(True))
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(lows.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = state(edges)
    for _ in range(most_rounds if before[0] else 0):
        after_df = materialize(star(star(edges, True), False), "cc")
        after = state(after_df)
        discard(edges)
        edges = after_df
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    child = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    out = child.union(child.select(F.col("component").alias("id"), "component").distinct())
    out._quarry_path = edges._quarry_path  # ``discard`` works on it
    return out


def slices(lengths: np.ndarray) -> np.ndarray:
    """Starts of runs of these lengths that lie one after another, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)])


def arrow_rows(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


def text_batches(batches: Iterator, *names: str, text: str = "text", most: int | None = None) -> Iterator[tuple[list, ...]]:
    """Columns as lists, in runs of rows whose texts have about ``most`` bytes together (a longer text is a run of its own), so that
    memory is bounded by texts and not by rows; a null text is empty. The session's settings stay as they are."""
    import pyarrow.compute as pc

    most = most or BATCH_CHARS
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: b.column(b.schema.get_field_index(n)) for n in names}
        ends = np.cumsum(pc.fill_null(pc.binary_length(cols[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            out = [cols[n].slice(begin, stop - begin).to_pylist() for n in names]
            if text in names:
                at = names.index(text)
                out[at] = ["" if t is None else t for t in out[at]]
            yield tuple(out)
            begin = stop
