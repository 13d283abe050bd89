"""Sequence and cache queries: each user's values by time; each event type's accesses by user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import sequence
from quarry.plans.base import query
from quarry.sources.tables import table

ORDER = ["ts", "event_id"]
S = "s as (select user_id, event_id, ts, value, row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events)"
A = "a as (select event_type, user_id as key, event_id as seq, lag(event_id) over (partition by event_type, user_id order by event_id) as prev from events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _scan(spark, sf_dir, start, schema):
    return sequence.scan(events(spark, sf_dir), "user_id", ORDER, ["value"], start, schema)


def _ranges(rows):
    low = F.col("user_id") % 5
    return rows.select("user_id").distinct().select("user_id", low.alias("low"), (low + 20).alias("high"))


_RANGE = "select u.user_id, u.low, u.high, round(coalesce(sum(v), 0), 6) as total, min(v) as least, max(v) as largest from (select distinct user_id, user_id % 5 as low, user_id % 5 + 20 as high from s) u left join x on x.user_id = u.user_id and idx between u.low and u.high group by 1, 2, 3"


@query(f"with {S}, x as (select user_id, idx, value as v from s) {_RANGE}")
def range_aggregate(spark, sf_dir):
    rows = sequence.positions(events(spark, sf_dir), "user_id", ORDER, F.to_date("ts"))
    return sequence.range_aggregate(rows, _ranges(rows), "user_id", "value").withColumn("total", F.round("total", 6))


@query(f"with {S}, x as (select s.user_id, idx, coalesce(2 * e.value, s.value) as v from s left join (select * from events where event_type = 'error') e using (event_id)) {_RANGE}")
def range_aggregate_updated(spark, sf_dir):
    """As before, after the values of error events have been assigned anew."""
    e = events(spark, sf_dir)
    updates = e.where("event_type = 'error'").select("event_id", (F.col("value") * 2).alias("assigned"))
    rows = sequence.positions(e, "user_id", ORDER, F.to_date("ts")).join(updates, "event_id", "left").withColumn("value", F.coalesce("assigned", "value"))
    return sequence.range_aggregate(rows, _ranges(rows), "user_id", "value").withColumn("total", F.round("total", 6))


@query(f"with {S} select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as running from s")
def prefix_sum(spark, sf_dir):
    out = sequence.running_sum(events(spark, sf_dir), "user_id", ORDER, "value", F.to_date("ts"))
    return out.select("event_id", "user_id", F.round("running", 6).alias("running"))


@query(f"with {S} select user_id, round(sum(value), 4) as total from s where idx between 10 and 20 group by user_id")
def range_sum(spark, sf_dir):
    """The sum of places 10 to 20 as a difference of two running sums; users with ten values or fewer have none."""
    rows = sequence.positions(events(spark, sf_dir), "user_id", ORDER, F.to_date("ts"))
    sums = sequence.running_sum(rows, "user_id", ORDER, "value", F.to_date("ts")).where("idx between 9 and 20").groupBy("user_id")
    got = sums.agg(F.max("idx").alias("last"), F.max_by("running", "idx").alias("upper"), F.min_by("running", "idx").alias("lower"))
    return got.where("last >= 10").select("user_id", F.round(F.col("upper") - F.col("lower"), 4).alias("total"))


@query(f"with {S} select a.user_id, count(b.idx) as n from s a left join s b on a.user_id = b.user_id and a.idx < b.idx and a.value > b.value group by a.user_id")
def inversion_count(spark, sf_dir):
    return _scan(spark, sf_dir, sequence.inversions, "n long")


@query(f"with {S} select a.user_id, a.idx, coalesce(min(b.idx), -1) as next from s a left join s b on a.user_id = b.user_id and b.idx > a.idx and b.value > a.value group by 1, 2")
def next_greater(spark, sf_dir):
    return _scan(spark, sf_dir, sequence.next_greater, "idx long, next long")


@query(f"with {S} select a.user_id, a.idx, coalesce(max(b.idx), -1) as previous from s a left join s b on a.user_id = b.user_id and b.idx < a.idx and b.value < a.value group by 1, 2")
def previous_smaller(spark, sf_dir):
    return _scan(spark, sf_dir, sequence.previous_smaller, "idx long, previous long")


@query(f"""with {S}, n as (select a.user_id, a.idx, a.value, coalesce(min(b.idx), (select max(idx) + 1 from s z where z.user_id = a.user_id)) as up from s a left join s b on a.user_id = b.user_id and b.idx > a.idx and b.value < a.value group by 1, 2, 3),
    p as (select a.user_id, a.idx, coalesce(max(b.idx), -1) as down from s a left join s b on a.user_id = b.user_id and b.idx < a.idx and b.value < a.value group by 1, 2)
    select user_id, round(max(value * (up - down - 1)), 6) as area from n join p using (user_id, idx) group by user_id""")
def largest_rectangle(spark, sf_dir):
    return _scan(spark, sf_dir, sequence.largest_rectangle, "area double").withColumn("area", F.round("area", 6))


@query(f"with {S}, w as (select event_id, user_id, idx, max(value) over (partition by user_id order by idx rows between 4 preceding and current row) as window_max from s) select event_id, user_id, window_max from w where idx >= 4")
def sliding_window_max(spark, sf_dir):
    return sequence.sliding_max(events(spark, sf_dir), "user_id", ORDER, "value", 5).select("event_id", "user_id", "window_max")


@query(f"""with {S}, r as (with recursive t(user_id, i, tails) as (select distinct user_id, 0::bigint, []::double[] from s
        union all select t.user_id, t.i + 1, list_concat(list_concat(tails[:len(list_filter(tails, lambda y: y < s.value))], [s.value]), tails[len(list_filter(tails, lambda y: y < s.value)) + 2:]) from t join s on s.user_id = t.user_id and s.idx = t.i)
        select user_id, arg_max(len(tails), i) as length from t group by user_id) select user_id, length from r""")
def lis_length(spark, sf_dir):
    return _scan(spark, sf_dir, sequence.increasing, "length long")


def _accesses(spark, sf_dir, start):
    return sequence.scan(events(spark, sf_dir), "event_type", ["event_id"], ["event_id", "user_id"], start, "seq long, key long, hit boolean")


#: Event ids in a slice of a cache's accesses.
SLICE = 100_000


def _hits(spark, sf_dir):
    return sequence.lru_hits(events(spark, sf_dir), "event_type", "event_id", "user_id", 20, F.floor(F.col("event_id") / SLICE))


_HITS = f"{A}, d as (select x.event_type, x.seq, x.key, x.prev, count(distinct y.key) as between_ from a x left join a y on x.prev is not null and y.event_type = x.event_type and y.seq > x.prev and y.seq < x.seq group by 1, 2, 3, 4), h as (select event_type, seq, key, prev is not null and between_ < 20 as hit from d)"


@query(f"with {_HITS} select event_type, seq, key, hit from h")
def lru_hits(spark, sf_dir):
    """A cache of 20 users for each event type; by stack distance in the SQL, by its state here."""
    return _hits(spark, sf_dir)


@query(f"with {_HITS} select event_type, count(*) as accesses, round(avg(hit::int), 9) as hit_rate from h group by event_type")
def cache_hit_rate(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("accesses"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("hit_rate"))


@query("with l as (select event_type, user_id as key, max(event_id) as seq from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by seq desc) as place from l) select event_type, key, place from r where place <= 20")
def lru_state(spark, sf_dir):
    """What each cache holds at the end, the most recent first."""
    last = events(spark, sf_dir).groupBy("event_type", F.col("user_id").alias("key")).agg(F.max("event_id").alias("seq"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("seq")))
    return last.withColumn("place", place).where("place <= 20").select("event_type", "key", F.col("place").cast("long").alias("place"))


@query()
def wtinylfu_hits(spark, sf_dir):
    return _accesses(spark, sf_dir, sequence.segmented(50))
