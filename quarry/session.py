"""Sessions, and the folder that a cluster's machines share."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: What ``once`` has written: the state of its source, by application, name and source.
_MADE: dict[tuple, tuple[str, str]] = {}


def local_session(app: str = "quarry", cores: str | int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster, pass the cluster's own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines share; one of our own only in local mode."""
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


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there, so a lost executor costs one re-read."""
    path = f"{shared_dir(df.sparkSession)}/settled/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what ``settle`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _state(source: DataFrame) -> tuple[str, str]:
    """Where a table of files lies, and a digest of the names, sizes and times of its files."""
    spark, files = source.sparkSession, sorted(source.inputFiles())
    conf, digest = spark._jsc.hadoopConfiguration(), hashlib.sha256()
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for s in at.getFileSystem(conf).listStatus(at):
            digest.update(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}\n".encode())
    return "\n".join(files), digest.hexdigest()


def once(source: DataFrame, name: str, make: Callable[[str], object]) -> str:
    """The path of what ``make(path)`` wrote for ``source``, a table of files: made at the first call of an application, and again when a
    file in the folders of the table has changed. Nothing is kept but files in the shared folder."""
    spark = source.sparkSession
    files, state = _state(source)
    key = spark.sparkContext.applicationId, name, files
    if _MADE.get(key, ("", ""))[0] != state:
        path = f"{shared_dir(spark)}/settled/{name}-{uuid.uuid4().hex}"
        make(path)
        _MADE[key] = state, path
    return _MADE[key][1]
