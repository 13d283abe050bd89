"""A versioned key-value log over any Spark table store: append, delete by tombstone, merge on read, flush, compaction, recovery.

Rows are (key, value, seq, is_tombstone). A run is a set of such rows sorted by key; reading merges runs by taking the highest
sequence number of each key. Nothing is updated in place, so writers append and compaction rewrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key long, value double, seq long, is_tombstone boolean"


def versions(df: DataFrame, key: Column, value: Column, seq: Column, tombstone: Column) -> DataFrame:
    return df.select(key.cast("long").alias("key"), value.cast("double").alias("value"), seq.cast("long").alias("seq"), F.coalesce(tombstone, F.lit(False)).alias("is_tombstone"))


def newest(log: DataFrame) -> DataFrame:
    """The last version of each key, tombstones included. Partial aggregation keeps one row a key and task before the shuffle."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "seq", "is_tombstone"), "seq").alias("v")).select("key", "v.value", "v.seq", "v.is_tombstone")


def live(log: DataFrame) -> DataFrame:
    """Merge on read: keys whose last version is no tombstone."""
    return newest(log).where("not is_tombstone").select("key", "value", "seq")


def get(log: DataFrame, key: int) -> DataFrame:
    """Point read: the filter reaches the scan, where row groups of sorted runs are skipped by their minimum and maximum."""
    return live(log.where(F.col("key") == key))


def put(log_dir: str, rows: DataFrame, run: int) -> None:
    """Flushes rows as one sorted run; Parquet keeps minimum and maximum of each row group, and a Bloom filter of the key."""
    sorted_rows = rows.select("key", "value", "seq", "is_tombstone").sortWithinPartitions("key", "seq")
    sorted_rows.write.option("parquet.bloom.filter.enabled#key", "true").mode("overwrite").parquet(f"{log_dir}/run={run:08d}")


def recover(spark: SparkSession, log_dir: str) -> DataFrame:
    """All runs of a log after a restart; ``run`` comes from the folder's name."""
    return spark.read.schema(f"{SCHEMA}, run int").option("basePath", log_dir).parquet(f"{log_dir}/run=*")


def compact(log: DataFrame, drop_tombstones: bool = True) -> DataFrame:
    """One run of the last versions; tombstones go where no older run can hold the key."""
    out = newest(log)
    return out.where("not is_tombstone") if drop_tombstones else out


def run_stats(log: DataFrame) -> DataFrame:
    """Rows, key range and tombstones of each run."""
    return log.groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n"), F.count_if("is_tombstone").alias("n_tombstones"))
