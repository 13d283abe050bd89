"""A crawler's data flow: frontier, micro-batches, the ring that places documents, expansion by depth, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import hash32
from quarry.operators.ranking import sliced_rank
from quarry.session import settle

#: Pattern of a link's target.
HREF = 'href="([^"]+)"'


def frontier(pages: DataFrame) -> DataFrame:
    """(host, n_urls, n_distinct) of the seeds by host."""
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("n_urls"), F.count_distinct("url").alias("n_distinct"))


def micro_batches(jobs: DataFrame, key: str, workers: int, slice_keys: int = 4096) -> DataFrame:
    """(key, tick, worker): jobs in order of an integer key, ``workers`` a tick, dealt round.

    Jobs are counted in slices of the key first, so none of the tasks numbers all of them.
    """
    place = F.col("rank")
    return sliced_rank(jobs.select(key), [], F.floor(F.col(key) / slice_keys), [F.col(key)]).select(key, F.floor(place / workers).alias("tick"), (place % workers).alias("worker"))


def ring(spark: SparkSession, nodes: list[str], copies: int = 100) -> DataFrame:
    """(hash, node): ``copies`` places of each distinct node on a ring of 2**32."""
    rows = spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "node string")
    each = rows.select("node", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("i"))
    return each.select(hash32(F.concat_ws("#", "node", F.col("i").cast("string"))).alias("hash"), "node")


def _places(places: DataFrame) -> Column:
    """The sorted ring as one array: a scalar subquery of a few hundred entries."""
    return places.agg(F.array_sort(F.collect_list(F.struct("hash", "node"))).alias("r")).select("r").scalar()


def route(rows: DataFrame, key: Column, places: DataFrame) -> DataFrame:
    """Adds ``node``: the first place at or after the key's hash, and from the end of the ring on to its start. A narrow map."""
    whole = rows.withColumn("h_", hash32(key)).withColumn("r_", _places(places))
    after = F.filter("r_", lambda p: p["hash"] >= F.col("h_"))
    return whole.withColumn("node", F.coalesce(F.get(after, F.lit(0))["node"], F.get("r_", F.lit(0))["node"])).drop("h_", "r_")


def rebalance(rows: DataFrame, key: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new, n): how many keys move when the ring changes, and from where to where."""
    both = route(route(rows.select(key), F.col(key), before).withColumnRenamed("node", "old"), F.col(key), after).withColumnRenamed("node", "new")
    return both.groupBy("old", "new").agg(F.count("*").alias("n"))


def expand(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth): all that is reached within ``depth`` links, each id once, at its least depth."""
    seen = settle(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "crawl")
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1)
        new = links.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        seen = settle(seen.unionByName(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(d))), "crawl")
    return seen


def status(pages: DataFrame, workers: int, shards: int) -> DataFrame:
    """One row: jobs, bytes, links found, distinct links, workers and shards."""
    hrefs = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    base = pages.select(F.octet_length("html").alias("b"), hrefs.alias("h"))
    found = base.select(F.explode("h").alias("u")).distinct().agg(F.count("*").alias("n")).select("n").scalar()
    return base.agg(F.count("*").alias("jobs"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("found")).select("jobs", "bytes", "found", found.alias("distinct_found"), F.lit(workers).alias("workers"), F.lit(shards).alias("shards"))
