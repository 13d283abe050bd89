"""Event-time windows, written once and run over a table or a stream.

Over a stream the watermark bounds state and says how late an event may be; over a table it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files; the schema is given, so nothing is inferred when the query starts."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _at(events: DataFrame, lateness: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(start_s, event_type, n, total) of each window of ``width``."""
    w = _at(events, lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(seconds(F.col("w.start")).alias("start_s"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """(start_s, event_type, n) of windows of ``width`` that start each ``step``."""
    w = _at(events, lateness).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(seconds(F.col("w.start")).alias("start_s"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """(user_id, start_s, n): runs of a user's events without a gap."""
    w = _at(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", seconds(F.col("w.start")).alias("start_s"), "n")


def distinct_events(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first event of each key: over a stream for as long as the watermark keeps the key."""
    if events.isStreaming:
        return _at(events, lateness).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def hot(events: DataFrame, key: Column, share: float) -> DataFrame:
    """(key, n) of keys with more than a share of all events."""
    counts = events.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("n")).select("n").scalar()
    return counts.where(F.col("n") > share * total)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a table in memory, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def upsert_log(stream: DataFrame, log_dir: str, checkpoint: str):
    """Appends each micro-batch as one sorted run of the key-value log; a batch that is repeated writes the same run again."""
    from quarry.sources.kvlog import put

    return stream.writeStream.foreachBatch(lambda df, epoch: put(log_dir, df, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
