"""Sketch queries, mostly over the users of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import hash32_sql
from quarry.operators import sketch
from quarry.plans.base import query
from quarry.sources.tables import table

M, K = sketch.bloom_size(10_000, 0.01)
W, D = sketch.cms_size(0.001, 0.01)
_BITS = f"bits as (select distinct ({hash32_sql('x')} + i * {hash32_sql('x', 1)}) % 4294967296 % {M} as bit from (select distinct user_id::varchar as x from events) cross join range({K}) r(i))"
_CELLS = f"cells as (select r.i::int as row, {hash32_sql("r.i || ':' || x")} % {W} as bucket, sum(n)::bigint as n from (select user_id::varchar as x, count(*) as n from events group by 1) cross join range({D}) r(i) group by 1, 2)"
_EST = f"""{_CELLS}, est as (select x as item, min(coalesce(n, 0)) as estimate from (select distinct user_id::varchar as x from events) cross join range({D}) r(i) left join cells on cells.row = r.i and cells.bucket = {hash32_sql("r.i || ':' || x")} % {W} group by x)"""
_TRUE = "truth as (select user_id::varchar as item, count(*) as n from events group by 1)"


def _regs(where: str = "true", name: str = "reg", p: int = 10) -> str:
    rest = f"(h << {p}) % 4294967296"
    return f"{name} as (select h >> {32 - p} as register, max(case when {rest} = 0 then {33 - p} else 32 - floor(log2({rest})) end)::int as rank from (select {hash32_sql('user_id::varchar')} as h from events where {where}) group by 1)"


def _hll(name: str = "reg", p: int = 10) -> str:
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    return f"s as (select coalesce(sum(pow(2::double, -rank)), 0) as s, {m} - count(*) as empty from {name}), raw as (select {alpha!r}::double * {m} * {m} / (s + empty) as e, empty from s), est as (select round(case when e <= {2.5 * m} and empty > 0 then {m} * ln({m}::double / empty) else e end)::bigint as estimate from raw)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("select n, rate::double as rate, ceil(-n * ln(rate) / pow(ln(2), 2))::bigint as m, greatest(1, round(ceil(-n * ln(rate) / pow(ln(2), 2)) / n * ln(2)))::bigint as k from (values (1000, 1e-2), (10000, 1e-2), (100000, 1e-2), (10000, 1e-3)) t(n, rate)")
def bloom_sizing(spark, sf_dir):
    rows = [(n, r, *sketch.bloom_size(n, r)) for n, r in ((1000, 0.01), (10_000, 0.01), (100_000, 0.01), (10_000, 0.001))]
    return spark.createDataFrame(rows, "n int, rate double, m long, k long")


@query(f"with {_BITS} select bit from bits")
def bloom_build(spark, sf_dir):
    return sketch.bloom(events(spark, sf_dir), "user_id", M, K)


@query(f"with {_BITS}, a as (select distinct c_custkey::varchar as x from customer), p as (select x, ({hash32_sql('x')} + i * {hash32_sql('x', 1)}) % 4294967296 % {M} as bit from a cross join range({K}) r(i)) select x as item, bool_and(bit in (select bit from bits)) as maybe from p group by x")
def bloom_probe(spark, sf_dir):
    bits = sketch.bloom(events(spark, sf_dir), "user_id", M, K)
    return sketch.bloom_probe(bits, table(spark, sf_dir, "customer"), "c_custkey", M, K)


@query(f"""with {_BITS}, c as (select count(*) as set_bits from bits) select set_bits, round(set_bits::double / {M}, 9) as fill, 1e-2 as target_rate, round(pow(1 - exp(-{K} * 10000::double / {M}), {K}), 9) as expected_rate,
    round(pow(set_bits::double / {M}, {K}), 9) as rate_by_fill, round(-{M}::double / {K} * ln(1 - set_bits::double / {M}))::bigint as estimated_items from c""")
def bloom_stats(spark, sf_dir):
    return sketch.bloom_stats(sketch.bloom(events(spark, sf_dir), "user_id", M, K), 10_000, M, K, 0.01)


@query(f"""with {_BITS}, a as (select distinct c_custkey::varchar as x from customer where c_custkey not in (select user_id from events)), p as (select x, ({hash32_sql('x')} + i * {hash32_sql('x', 1)}) % 4294967296 % {M} as bit from a cross join range({K}) r(i)),
    m as (select x, bool_and(bit in (select bit from bits)) as maybe from p group by x) select count(*) as probes, count(*) filter (maybe) as false_positives, round(coalesce(count(*) filter (maybe)::double / nullif(count(*), 0), 0), 9) as rate from m""")
def bloom_fpr(spark, sf_dir):
    e = events(spark, sf_dir)
    absent = table(spark, sf_dir, "customer").join(e.select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")
    got = sketch.bloom_probe(sketch.bloom(e, "user_id", M, K), absent, "c_custkey", M, K)
    return got.agg(F.count("*").alias("probes"), F.count_if("maybe").alias("false_positives"), F.round(F.coalesce(F.try_divide(F.count_if("maybe"), F.count("*")), F.lit(0.0)), 9).alias("rate"))


@query("select e::double as epsilon, d::double as delta, ceil(exp(1) / e)::bigint as width, ceil(ln(1 / d))::bigint as depth from (values (1e-3, 1e-2), (1e-2, 1e-2), (1e-3, 1e-3)) t(e, d)")
def cms_sizing(spark, sf_dir):
    return spark.createDataFrame([(e, d, *sketch.cms_size(e, d)) for e, d in ((0.001, 0.01), (0.01, 0.01), (0.001, 0.001))], "epsilon double, delta double, width long, depth long")


@query(f"with {_CELLS} select row, bucket, n from cells")
def cms_build(spark, sf_dir):
    return sketch.cms(events(spark, sf_dir), "user_id", W, D)


@query(f"with {_EST} select item, estimate from est")
def cms_estimate(spark, sf_dir):
    e = events(spark, sf_dir)
    return sketch.cms_estimate(sketch.cms(e, "user_id", W, D), e, "user_id", W, D)


@query(f"with {_CELLS} select row, bucket, n from cells")
def cms_merge(spark, sf_dir):
    """Tables of two halves of the stream, merged: the table of the whole."""
    e = events(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return sketch.cms_merge(sketch.cms(e.where(early), "user_id", W, D), sketch.cms(e.where(~early), "user_id", W, D))


@query(f"with {_EST} select item, estimate, round(estimate::double / (select count(*) from events), 9) as share from est order by estimate desc, item limit 10")
def cms_topk(spark, sf_dir):
    e = events(spark, sf_dir)
    est = sketch.cms_estimate(sketch.cms(e, "user_id", W, D), e, "user_id", W, D)
    total = e.agg(F.count("*").alias("n")).select("n").scalar()
    return est.orderBy(F.desc("estimate"), "item").limit(10).select("item", "estimate", F.round(F.col("estimate") / total, 9).alias("share"))


@query(f"with {_EST}, {_TRUE} select max(estimate - n) as largest_error, round(avg(estimate - n), 6) as mean_error, bool_and(estimate >= n) as never_below, max(estimate - n) <= 1e-3 * (select count(*) from events) as within_bound from est join truth using (item)")
def cms_error(spark, sf_dir):
    e = events(spark, sf_dir)
    est = sketch.cms_estimate(sketch.cms(e, "user_id", W, D), e, "user_id", W, D)
    truth = e.groupBy(F.col("user_id").cast("string").alias("item")).agg(F.count("*").alias("n"))
    gap = F.col("estimate") - F.col("n")
    total = e.agg(F.count("*").alias("n")).select("n").scalar()
    return est.join(truth, "item").agg(F.max(gap).alias("largest_error"), F.round(F.avg(gap), 6).alias("mean_error"), F.bool_and(gap >= 0).alias("never_below"), F.max(gap).alias("m")).select("largest_error", "mean_error", "never_below", (F.col("m") <= 0.001 * total).alias("within_bound"))


@query("select user_id, count(*) as n from events group by user_id having count(*) > 0.001 * (select count(*) from events)")
def heavy_hitters(spark, sf_dir):
    e = events(spark, sf_dir)
    total = e.agg(F.count("*").alias("n")).select("n").scalar()
    return e.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > 0.001 * total)


@query()
def distinct_hll(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query(f"with {_regs()} select register, rank from reg")
def hll_registers(spark, sf_dir):
    return sketch.hll_registers(events(spark, sf_dir), "user_id")


@query(f"with {_regs()}, {_hll()} select estimate, 0.0325::double as error from est")
def hll_estimate(spark, sf_dir):
    return sketch.hll_estimate(sketch.hll_registers(events(spark, sf_dir), "user_id"))


@query(f"with {_regs()}, {_hll()} select estimate, 0.0325::double as error from est")
def hll_union(spark, sf_dir):
    """Registers of two halves of the stream, merged: the estimate of the whole."""
    e = events(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    both = sketch.hll_merge(sketch.hll_registers(e.where(early), "user_id"), sketch.hll_registers(e.where(~early), "user_id"))
    return sketch.hll_estimate(both)


_QBITS = f"zero as (select distinct c_name as x from customer where c_acctbal < 0), zb as (select distinct ({hash32_sql('x')} + i * {hash32_sql('x', 1)}) % 4294967296 % {M} as bit from zero cross join range({K}) r(i))"


@query(f"with {_QBITS}, p as (select c_name, ({hash32_sql('c_name')} + i * {hash32_sql('c_name', 1)}) % 4294967296 % {M} as bit from (select distinct c_name from customer) cross join range({K}) r(i)) select c_name as item, bool_and(bit in (select bit from zb)) as maybe from p group by c_name")
def negative_cache(spark, sf_dir):
    """Names without result (here: customers in debt) go into a filter that answers before the query runs."""
    c = table(spark, sf_dir, "customer")
    return sketch.bloom_probe(sketch.bloom(c.where("c_acctbal < 0"), "c_name", M, K), c, "c_name", M, K)
