"""Scans, lookups, the key-value log, ordered maps, filters and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.plans.base import query
from quarry.sources import kvlog
from quarry.sources.tables import json_rows, table

LOG = "log as (select o_custkey::bigint as key, o_totalprice as value, o_orderkey::bigint as seq, o_orderstatus = 'F' as is_tombstone, (o_orderkey // 1000)::bigint as run from orders)"
NEW = f"with {LOG}, new as (select key, arg_max(value, seq) as value, max(seq) as seq, arg_max(is_tombstone, seq) as is_tombstone from log group by key)"


def order_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = kvlog.versions(o, F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_orderstatus") == "F")
    return log.withColumn("run", F.floor(F.col("seq") / 1000).cast("long"))


@query("select doc_id, lang, source, n_chars from documents where doc_id = 7")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 7).select("doc_id", "lang", "source", "n_chars")


@query("select page_id from pages")
def id_projection(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id")


@query("select doc_id, lang, source, n_chars, length(text)::bigint as length from documents")
def doc_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("length"))


@query(f"{NEW} select key, value, seq, is_tombstone from new")
def kv_upsert_latest(spark, sf_dir):
    return kvlog.newest(order_log(spark, sf_dir))


@query(f"{NEW} select key, seq from new where is_tombstone")
def kv_delete_tombstone(spark, sf_dir):
    return kvlog.newest(order_log(spark, sf_dir)).where("is_tombstone").select("key", "seq")


@query(f"{NEW} select key, value, seq from new where not is_tombstone")
def kv_merge_read(spark, sf_dir):
    return kvlog.live(order_log(spark, sf_dir))


@query(f"with {LOG} select run, min(key) as min_key, max(key) as max_key, count(*) as n, count(*) filter (is_tombstone) as n_tombstones from log group by run")
def kv_flush_stats(spark, sf_dir):
    return kvlog.run_stats(order_log(spark, sf_dir))


@query(f"{NEW} select key, value, seq, is_tombstone from new where not is_tombstone")
def kv_compaction(spark, sf_dir):
    return kvlog.compact(order_log(spark, sf_dir))


@query(f"""with {LOG}, f as (select key, (seq // 8)::bigint as flush from log), l as (select flush // 4 as merged, key from f)
    select merged, count(*) as n, count(distinct key) as n_keys, min(key) as min_key, max(key) as max_key from l group by merged""")
def kv_level_layout(spark, sf_dir):
    """Flushes of eight writes each, four of them merged into one run of the next level."""
    return order_log(spark, sf_dir).groupBy(F.floor(F.floor(F.col("seq") / 8) / 4).alias("merged")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("""select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as json from region""")
def result_json(spark, sf_dir):
    return json_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("select p_partkey, p_name, p_retailprice from part where p_retailprice between 910 and 920")
def range_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_retailprice").between(910.0, 920.0)).select("p_partkey", "p_name", "p_retailprice")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 400000")
def min_score_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= 400000.0).select("o_orderkey", "o_totalprice")


@query(f"{NEW} select key, value from new where not is_tombstone and key not in (select s_suppkey from supplier)")
def ordered_map_ops(spark, sf_dir):
    """Inserts and updates by last version, then deletions of a key list by an anti join."""
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return kvlog.live(order_log(spark, sf_dir)).join(gone, "key", "left_anti").select("key", "value")


@query(f"{NEW} select key, value from new where not is_tombstone and key between 25 and 75 order by key")
def ordered_range(spark, sf_dir):
    log = order_log(spark, sf_dir).where(F.col("key").between(25, 75))
    return kvlog.live(log).select("key", "value").orderBy("key")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def topk(spark, sf_dir):
    return ranking.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 20)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 1")
def heap_min(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(1)


@query("""with h as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as idx from
        (select * from orders order by o_totalprice desc, o_orderkey limit 100))
    select idx, floor(log2(idx + 1))::bigint as level, case when idx > 0 then (idx - 1) // 2 end as parent, o_orderkey, o_totalprice from h""")
def heap_levels(spark, sf_dir):
    """The 100 largest as a min-heap in array order: level and parent of each entry."""
    return ranking.heap(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100)


@query("""select o_custkey, o_orderkey, o_totalprice, rank::bigint as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3""")
def topk_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 3").withColumn("rank", F.col("rank").cast("long"))


@query("""select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high,
    round(stddev_pop(value), 6) as deviation, round(1000 / avg(value), 6) as per_second from events group by event_type""")
def latency_stats(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_pop(v), 6).alias("deviation"), F.round(1000 / F.avg(v), 6).alias("per_second"))


_MEANS = "m as (select event_type, avg(value) as mean from events group by event_type)"


@query(f"with {_MEANS} select a.event_type as base, b.event_type as other, round(a.mean / b.mean, 6) as speedup, case when a.mean > b.mean then b.event_type else a.event_type end as faster from m a join m b on a.event_type < b.event_type")
def speedup_compare(spark, sf_dir):
    """Each two event types by mean; the compared side has one row a type."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    a, b = m.select(F.col("event_type").alias("base"), F.col("mean").alias("x")), m.select(F.col("event_type").alias("other"), F.col("mean").alias("y"))
    faster = F.when(F.col("x") > F.col("y"), F.col("other")).otherwise(F.col("base"))
    return a.join(b, F.col("base") < F.col("other")).select("base", "other", F.round(F.col("x") / F.col("y"), 6).alias("speedup"), faster.alias("faster"))


@query("""with m as (select event_type, day(ts)::bigint as size, sum(value) as time from events group by 1, 2),
    r as (select event_type, max(size)::double / min(size) as s, arg_max(time, size) / arg_min(time, size) as t, count(*) as n from m group by event_type)
    select event_type, case when n < 2 then 'Unknown' when t < log2(s) * 1.5 then 'O(log n)' when t < s * 1.5 then 'O(n)' when t < s * log2(s) * 1.5 then 'O(n log n)' when t < s * s * 1.5 then 'O(n²)' else 'O(n^k) or worse' end as complexity from r""")
def complexity_class(spark, sf_dir):
    """Each event type's daily sums as measurements, the day of the month being the size."""
    m = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").cast("long").alias("size")).agg(F.sum("value").alias("time"))
    return ranking.complexity(m, "event_type", "size", "time")


@query("select event_type, count(*) as steps, epoch_us(max(ts))::bigint as last_us, (epoch_us(max(ts)) - epoch_us(min(ts)))::bigint as span_us from events group by event_type")
def trace_summary(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("steps"), F.max(at).alias("last_us"), (F.max(at) - F.min(at)).alias("span_us"))
