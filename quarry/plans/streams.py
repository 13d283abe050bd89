"""Queries of the streaming operators over tables; tests run the same functions over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import hash32_sql
from quarry.plans.base import query
from quarry.plans.graphs import E, links
from quarry.sources.tables import table
from quarry.streaming import crawl, windows

NODES = ["db-shard-1", "db-shard-2", "db-shard-3"]
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def _ring(name: str, nodes: list[str]) -> str:
    return f"{name} as (select {hash32_sql("node || '#' || i")} as hash, node from (select unnest({nodes!r}) as node) cross join range(100) r(i))"


def _route(name: str, places: str) -> str:
    return f"{name} as (select url, coalesce((select arg_min(node, hash) from {places} where hash >= {hash32_sql('url')}), (select arg_min(node, hash) from {places})) as node from (select distinct url from pages))"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query(f"select {HOST} as host, count(*) as n_urls, count(distinct url) as n_distinct from pages group by 1")
def crawl_frontier(spark, sf_dir):
    return crawl.frontier(pages(spark, sf_dir))


@query("select page_id, ((row_number() over (order by page_id) - 1) // 3)::bigint as tick, ((row_number() over (order by page_id) - 1) % 3)::bigint as worker from pages")
def micro_batch_assign(spark, sf_dir):
    return crawl.micro_batches(pages(spark, sf_dir), "page_id", 3)


@query(f"with {E}, r as (with recursive t(id, depth) as (select id, 0 from v where id < 5 union select e.dst, depth + 1 from t join e on e.src = t.id where depth < 3) select id, min(depth) as depth from t group by id) select id, depth::int as depth from r")
def crawl_expand(spark, sf_dir):
    seeds = pages(spark, sf_dir).where("page_id < 5").select(F.col("page_id").alias("id"))
    return crawl.expand(links(spark, sf_dir), seeds, 3)


@query(f"with h as (select unnest(regexp_extract_all(html, '{crawl.HREF}', 1)) as u from pages) select (select count(*) from pages) as jobs, (select sum(strlen(html)) from pages)::bigint as bytes, count(*) as found, count(distinct u) as distinct_found, 3 as workers, 3 as shards from h")
def crawl_status(spark, sf_dir):
    return crawl.status(pages(spark, sf_dir), 3, 3)


@query(f"with {_ring('ring', NODES)} select hash, node from ring")
def hash_ring(spark, sf_dir):
    return crawl.ring(spark, NODES)


@query(f"with {_ring('ring', NODES)}, {_route('got', 'ring')} select url, node from got")
def consistent_hash_route(spark, sf_dir):
    urls = pages(spark, sf_dir).select("url").distinct()
    return crawl.route(urls, F.col("url"), crawl.ring(spark, NODES))


@query(f"with {_ring('r1', NODES)}, {_ring('r2', NODES[:2])}, {_route('a', 'r1')}, {_route('b', 'r2')} select a.node as old, b.node as new, count(*) as n from a join b using (url) group by 1, 2")
def shard_rebalance(spark, sf_dir):
    urls = pages(spark, sf_dir).select("url").distinct()
    return crawl.rebalance(urls, "url", crawl.ring(spark, NODES), crawl.ring(spark, NODES[:2]))


@query("select json_extract_string(props, '$.k') as key, count(*) as n from events group by 1 having count(*) > 0.001 * (select count(*) from events)")
def hot_queries(spark, sf_dir):
    return windows.hot(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k"), 0.001)


@query("select epoch(time_bucket(interval '1 hour', ts))::bigint as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("select epoch(time_bucket(interval '2 hours', ts, timestamp '1970-01-01'))::bigint - 7200 * k as start_s, event_type, count(*) as n from events cross join range(3) r(k) group by 1, 2")
def events_sliding(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g)
    select user_id, floor(epoch(min(ts)))::bigint as start_s, count(*) as n from s group by user_id, session""")
def events_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"))


@query("select event_type, count(distinct user_id) as n from events group by event_type")
def events_dedup_watermark(spark, sf_dir):
    kept = windows.distinct_events(table(spark, sf_dir, "events"), ["event_type", "user_id"])
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))
