"""Graph queries over the link graph of ``pages``; all pairs over the trade graph of ``nation``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import hash32, hash32_sql
from quarry.operators import graph
from quarry.plans.base import query
from quarry.sources.tables import table

_HREF = 'href="([^"]+)"'
E = f"""v as (select page_id as id from pages),
    e as (select distinct page_id as src, {hash32_sql("href")} % (select count(*) from pages) as dst from (select page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) as href from pages)),
    ew as (select src, dst, (1 + (src * 7 + dst) % 9)::bigint as weight from e)"""
#: Closure and what follows from it; only for oracles, on small graphs.
CLOSURE = f"{E}, reach as (with recursive r as (select src as x, dst as y from e union select r.x, e.dst from r join e on e.src = r.y) select x, y from r)"


def vertices(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))


def links(spark, sf_dir):
    """Anchors name no pages of the table, so a link's target is its hash modulo the number of pages."""
    pages = table(spark, sf_dir, "pages")
    n = pages.agg(F.count("*").alias("n")).select("n").scalar()
    hrefs = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    return hrefs.select("src", (hash32(F.col("href")) % n).alias("dst")).distinct()


def weighted(spark, sf_dir):
    return links(spark, sf_dir).select("src", "dst", (1 + (F.col("src") * 7 + F.col("dst")) % 9).alias("weight"))


def _ranks(extra: str = "", seeds: tuple[int, ...] = (), tolerance: float = 1e-4, norm: str = "max") -> str:
    home = f"case when id in ({', '.join(map(str, seeds))}) then 1::double / {len(seeds)} else 0 end" if seeds else "1::double / (select count(*) from v)"
    agg = "max" if norm == "max" else "sum"
    scale = "/ (select sum(r) from pr where i = (select i from stop))" if seeds else ""
    return f"""with recursive {E}, deg as (select src, count(*) as d from e group by src), h as (select id, {home} as home from v),
    pr(i, id, r) as (select 0, id, home from h
        union all
        select p.i, h.id, 0.15::double * h.home + 0.85::double * coalesce(sum(x.r / deg.d), 0)
        from (select distinct i + 1 as i from pr where i < 100) p cross join h left join e on e.dst = h.id left join pr x on x.id = e.src left join deg on deg.src = e.src group by p.i, h.id, h.home),
    diff as (select a.i, {agg}(abs(a.r - b.r)) as d from pr a join pr b on a.id = b.id and b.i = a.i - 1 group by a.i),
    stop as (select coalesce(min(i) filter (d < {tolerance}), 100) as i from diff),
    ranks as (select id, r {scale} as rank from pr where i = (select i from stop)){extra} """


@query(f"with {E} select id from v where id in (select src from e) or id in (select dst from e)")
def graph_build(spark, sf_dir):
    return graph.build(links(spark, sf_dir))


@query(f"with {E} select (select count(*) from v) as n_vertices, count(*) as n_edges, round(count(*)::double / ((select count(*) from v) * ((select count(*) from v) - 1)), 9) as density from e")
def graph_stats(spark, sf_dir):
    return graph.stats(vertices(spark, sf_dir), links(spark, sf_dir))


@query(f"with {E} select id, coalesce(src // 1000, 0)::bigint as part, count(src) as n_in, array_to_string(list(src order by src) filter (src is not null), ',') as sources from v left join e on dst = id group by 1, 2")
def reverse_link_graph(spark, sf_dir):
    r = graph.reverse(vertices(spark, sf_dir), links(spark, sf_dir))
    return r.select("id", "part", "n_in", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query(f"{_ranks()} select id, round(rank, 9) as rank from ranks")
def pagerank(spark, sf_dir):
    ranks, _ = graph.pagerank(vertices(spark, sf_dir), links(spark, sf_dir))
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query(f"{_ranks(tolerance=1e-6, norm='l1')} select id, round(rank, 9) as rank from ranks")
def pagerank_l1(spark, sf_dir):
    ranks, _ = graph.pagerank(vertices(spark, sf_dir), links(spark, sf_dir), tolerance=1e-6, norm="l1")
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query(f"{_ranks()} select i::bigint as iteration, round(d, 9) as change from diff where i <= (select i from stop)")
def pagerank_history(spark, sf_dir):
    _, history = graph.pagerank(vertices(spark, sf_dir), links(spark, sf_dir))
    return spark.createDataFrame([(k, float(d)) for k, d in enumerate(history, 1)], "iteration long, change double").select("iteration", F.round("change", 9).alias("change"))


_TOP = """, top as (select id, round(rank, 9) as rank, (select count(*) from e where dst = ranks.id) as n_in, (select count(*) from e where src = ranks.id) as n_out from ranks order by round(rank, 9) desc, id limit 10)"""


@query(f"{_ranks(_TOP)} select * from top")
def pagerank_top(spark, sf_dir):
    e = links(spark, sf_dir)
    ranks, _ = graph.pagerank(vertices(spark, sf_dir), e)
    best = ranks.select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(10)
    ins, outs = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    return best.join(ins, "id", "left").join(outs, "id", "left").select("id", "rank", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query(f"{_ranks(_TOP)} select src, dst from e where src in (select id from top) and dst in (select id from top)")
def induced_subgraph(spark, sf_dir):
    e = links(spark, sf_dir)
    ranks, _ = graph.pagerank(vertices(spark, sf_dir), e)
    return graph.induced(e, ranks.select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(10))


@query(f"{_ranks(seeds=(1, 2), tolerance=1e-6, norm='l1')} select id, round(rank, 9) as rank from ranks order by rank desc, id limit 10")
def personalized_pagerank(spark, sf_dir):
    ranks, _ = graph.pagerank(vertices(spark, sf_dir), links(spark, sf_dir), tolerance=1e-6, norm="l1", seeds=[1, 2, 2])
    return ranks.select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(10)


@query(f"with {E}, d as (with recursive r as (select 0::bigint as id, 0::bigint as h union select e.dst, h + 1 from r join e on e.src = r.id where h < (select count(*) from v) and h < 60) select id, min(h) as h from r group by id) select id, h as distance from d")
def bfs_shortest_path(spark, sf_dir):
    """Hops from vertex 0 to every vertex that it reaches."""
    d, _ = graph.distances(links(spark, sf_dir), 0, weight=None)
    return d.select("id", "distance")


#: Distances from 0: states (vertex, distance) below a bound that every true distance keeps.
_DIST = f"{E}, d as (with recursive r as (select 0::bigint as id, 0::bigint as t union select ew.dst, t + weight from r join ew on ew.src = r.id where t + weight <= 120) select id, min(t) as t from r group by id)"


@query(f"with {_DIST}, p as (select ew.dst as id, min(ew.src) as predecessor from ew join d a on a.id = ew.src join d b on b.id = ew.dst where a.t + weight = b.t group by ew.dst) select d.id, t::double as distance, predecessor from d left join p on p.id = d.id")
def sssp(spark, sf_dir):
    e = weighted(spark, sf_dir)
    d, _ = graph.distances(e, 0)
    return graph.predecessors(e, d)


@query(f"""with {_DIST}, tight as (select ew.* from ew join d a on a.id = ew.src join d b on b.id = ew.dst where a.t + weight = b.t),
    paths as (with recursive r as (select 0::bigint as id, [0::bigint] as path union all select tight.dst, list_append(path, tight.dst) from r join tight on tight.src = r.id) select id, min(path) as path from r group by id)
    select d.id, t::double as distance, array_to_string(path, '>') as path from d join paths on paths.id = d.id""")
def sssp_path(spark, sf_dir):
    origin = spark.createDataFrame([(0,)], "origin long")
    p = graph.best_paths(weighted(spark, sf_dir), origin)
    return p.select("id", "distance", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"with {E}, ne as (select src, dst, weight - 4 as weight from ew where src < dst), d as (with recursive r as (select 0::bigint as id, 0::bigint as t union select ne.dst, t + weight from r join ne on ne.src = r.id) select id, min(t) as t from r group by id) select id, t::double as distance, false as negative_cycle from d")
def bellman_ford(spark, sf_dir):
    """Weights of both signs on the links that lead upwards: there is no cycle, so no negative one."""
    up = weighted(spark, sf_dir).where("src < dst").withColumn("weight", F.col("weight") - 4)
    d, negative = graph.distances(up, 0)
    return d.select("id", "distance", F.lit(negative).alias("negative_cycle"))


@query(f"with {E}, z as (select src, dst, (src + dst) % 2 as weight from e), d as (with recursive r as (select 0::bigint as id, 0::bigint as t union select z.dst, t + weight from r join z on z.src = r.id where t + weight <= 40) select id, min(t) as t from r group by id) select id, t::double as distance from d")
def zero_one_bfs(spark, sf_dir):
    d, _ = graph.distances(links(spark, sf_dir).withColumn("weight", (F.col("src") + F.col("dst")) % 2), 0)
    return d.select("id", "distance")


@query(f"with {CLOSURE} select id, coalesce((select min(a.y) from reach a join reach b on a.y = b.x and b.y = a.x where a.x = v.id), id) as component from v")
def scc(spark, sf_dir):
    return graph.strong_components(vertices(spark, sf_dir), links(spark, sf_dir))


@query(f"with {CLOSURE}, c as (select id, coalesce((select min(a.y) from reach a join reach b on a.y = b.x and b.y = a.x where a.x = v.id), id) as component from v), s as (select component, count(*) as size from c group by component) select size, count(*) as n from s group by size")
def scc_size_histogram(spark, sf_dir):
    s = graph.strong_components(vertices(spark, sf_dir), links(spark, sf_dir))
    return s.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(f"""with {CLOSURE}, cyc as (select x as id from reach where x = y), bad as (select id from cyc union select y from reach join cyc on x = id),
    lv as (with recursive r as (select id, 0 as h from v where id not in (select id from bad) union select e.dst, h + 1 from r join e on e.src = r.id where e.dst not in (select id from bad)) select id, max(h) as h from r group by id)
    select v.id, h::bigint as level from v left join lv on lv.id = v.id""")
def topo_levels(spark, sf_dir):
    return graph.topological_levels(vertices(spark, sf_dir), links(spark, sf_dir))


@query(f"with {E}, d as (with recursive r as (select 0::bigint as id, 0::bigint as t union select e.dst, t + 1 + e.dst % 5 from r join e on e.src = r.id and e.src < e.dst) select id, max(t) as t from r group by id) select id, t::double as total from d")
def dag_longest_path(spark, sf_dir):
    up = links(spark, sf_dir).where("src < dst")
    weights = vertices(spark, sf_dir).select("id", (1 + F.col("id") % 5).alias("weight"))
    return graph.longest_paths(up, weights, 0)


@query(f"with {E}, b as (select src, dst from e union select dst, src from e), c as (with recursive r as (select id as x, id as y from v union select r.x, b.dst from r join b on b.src = r.y) select x, min(y) as m from r group by x) select x as id, m as component from c")
def connected_components(spark, sf_dir):
    return graph.components(vertices(spark, sf_dir), links(spark, sf_dir))


@query()
def mst(spark, sf_dir):
    return graph.spanning_forest(vertices(spark, sf_dir), weighted(spark, sf_dir))


_TRADE = """nv as (select n_nationkey::bigint as id from nation),
    ne as (select c_nationkey::bigint as src, s_nationkey::bigint as dst, (1 + count(*) % 9)::bigint as weight from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
        where c_nationkey <> s_nationkey group by 1, 2),
    d as (with recursive r as (select id as a, id as b, 0::bigint as t from nv union select r.a, ne.dst, t + weight from r join ne on ne.src = r.b where t + weight <= 30) select a, b, min(t) as t from r group by a, b)"""


def trade(spark, sf_dir):
    """(src, dst, weight) between nations of customers and suppliers: a graph of as many vertices as there are nations, at any scale."""
    line, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).where("c_nationkey <> s_nationkey")
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg((1 + F.count("*") % 9).alias("weight"))


@query(f"with {_TRADE} select a as src, b as dst, t::double as distance from d")
def apsp(spark, sf_dir):
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    return graph.best_paths(trade(spark, sf_dir), origins).select(F.col("origin").alias("src"), F.col("id").alias("dst"), "distance")


@query(f"""with {_TRADE}, tight as (select x.a, ne.src, ne.dst from d x join ne on ne.src = x.b join d y on y.a = x.a and y.b = ne.dst where x.t + weight = y.t),
    paths as (with recursive r as (select id as a, id as b, [id] as path from nv union all select r.a, tight.dst, list_append(path, tight.dst) from r join tight on tight.a = r.a and tight.src = r.b) select a, b, min(path) as path from r group by a, b)
    select a as src, b as dst, array_to_string(path, '>') as path from paths""")
def apsp_path(spark, sf_dir):
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin"))
    p = graph.best_paths(trade(spark, sf_dir), origins)
    return p.select(F.col("origin").alias("src"), F.col("id").alias("dst"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))
