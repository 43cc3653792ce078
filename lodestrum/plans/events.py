"""Queries over the event table: sessions, windows, grouping sets, as-of joins and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.plans.registry import query
from lodestrum.sources.tables import table
from lodestrum.streaming.changes import without_repeats

GAP = "1 hour"


@query("select user_id, min(ts) as started, count(*) as n, arg_max(event_type, ts) as last_type from (select *, sum(case when p is null or ts >= p + interval 1 hour then 1 else 0 end) over (partition by user_id order by ts, event_id) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) group by user_id, s")
def str_batch_changes(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.groupBy("user_id", F.session_window("ts", GAP).alias("s")).agg(F.count("*").alias("n"), F.max_by("event_type", "ts").alias("last_type"))
    return g.select("user_id", F.col("s.start").alias("started"), "n", "last_type")


@query("select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def str_tumbling(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("select event_type, day, n from (select event_type, cast(ts as date) as day, count(*) as n from events group by grouping sets ((event_type, cast(ts as date)), (event_type), ()))")
def ext_rollup(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return ev.rollup("event_type", "day").agg(F.count("*").alias("n"))


@query("select event_type, weekday, n from (select event_type, (event_id % 7) as weekday, count(*) as n from events group by cube (event_type, (event_id % 7)))")
def ext_cube(spark, sf):
    return table(spark, sf, "events").withColumn("weekday", F.col("event_id") % 7).cube("event_type", "weekday").agg(F.count("*").alias("n"))


@query("select e.event_id as id, p.event_id as before from events e asof left join (select * from events where event_type = 'click') p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type = 'error'")
def ext_asof(spark, sf):
    """The user's last click at or before each error: one sort for each user, no pairs."""
    ev = table(spark, sf, "events").where("event_type in ('click', 'error')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return ev.withColumn("before", last).where("event_type = 'error'").select(F.col("event_id").alias("id"), "before")


@query("select event_id, ts, user_id, event_type, value, props from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def str_dedupe(spark, sf):
    """The first event of each user and type; the later ones repeat its job."""
    return without_repeats(table(spark, sf, "events"), by=("user_id", "event_type"))


@query("select user_id, n, m, round(s, 6) as s from (select user_id, count(*) as n, round(avg(value), 6) as m, stddev_pop(value) as s from events where event_type <> 'view' group by user_id)")
def str_state_stats(spark, sf):
    """Count, mean and spread from sums that events add to and retractions take from: views are taken away again."""
    ev = table(spark, sf, "events").select("user_id", F.col("value").alias("v"), F.lit(1).alias("k"), "event_type")
    both = ev.union(ev.where("event_type = 'view'").withColumn("k", F.lit(-1)))
    g = both.groupBy("user_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("v")).alias("s1"), F.sum(F.col("k") * F.col("v") * F.col("v")).alias("s2")).where("n > 0")
    mean = F.col("s1") / F.col("n")
    return g.select("user_id", "n", F.round(mean, 6).alias("m"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)), 6).alias("s"))
