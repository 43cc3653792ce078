"""Queries of snapshot differences, joins and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.operators import changes as op
from lodestrum.plans.registry import query
from lodestrum.sources.tables import entries, snapshots, sql, table, vectors

DIFF = """failed as (select path, mtime from entries where id % 19 = 0),
diff_ as (select coalesce(n.path, b.path) as path, coalesce(n.path <> b.path, false) as respelled, b.size as b_size, b.mtime as b_mtime, n.size as n_size, n.mtime as n_mtime,
  case when n.mtime is null then 'removed' when f.mtime = n.mtime then 'failed' when b.mtime is null then 'added' when b.mtime <> n.mtime then 'changed' else 'same' end as kind
  from before b full join now_ n on lower(b.path) = lower(n.path) left join failed f on f.path = coalesce(n.path, b.path)),
gone as (select b_size as size, b_mtime as mtime, min(path) as old from diff_ where kind = 'removed' group by all having count(*) = 1),
come as (select n_size as size, n_mtime as mtime, min(path) as new from diff_ where kind = 'added' group by all having count(*) = 1)"""


def _diff(spark, sf):
    before, now = snapshots(spark, sf)
    return op.diff(before, now, entries(spark, sf).where("id % 19 = 0").select("path", "mtime"), fold_case=True)


@query(sql("entries snapshots", "select path, kind, respelled from diff_", DIFF))
def cdc_diff(spark, sf):
    return _diff(spark, sf).select("path", "kind", "respelled")


@query(sql("entries snapshots", "select kind, count(*) as n from diff_ group by kind", DIFF))
def join_full_outer(spark, sf):
    return _diff(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(sql("entries snapshots", "select path, kind from diff_ where kind not in ('same', 'failed')", DIFF))
def scan_reconcile(spark, sf):
    return _diff(spark, sf).where("kind not in ('same', 'failed')").select("path", "kind")


@query(sql("entries snapshots", "select old, new from gone join come using (size, mtime)", DIFF))
def cdc_rename_match(spark, sf):
    return op.rename_pairs(_diff(spark, sf))


@query(sql("entries snapshots", "select size, mtime, old from gone", DIFF))
def join_composite_unique(spark, sf):
    c = _diff(spark, sf).where("kind = 'removed'").groupBy(F.col("b_size").alias("size"), F.col("b_mtime").alias("mtime"))
    return c.agg(F.min("path").alias("old"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(sql("entries snapshots", "select n.path from now_ n where not exists (select 1 from before b where b.path = n.path and b.mtime = n.mtime)"))
def cdc_touch(spark, sf):
    before, now = snapshots(spark, sf)
    return now.join(before.select("path", "mtime"), ["path", "mtime"], "left_anti").select("path")


@query(sql("entries snapshots", "select n.path from now_ n where not exists (select 1 from entries e where e.id % 19 = 0 and e.path = n.path and e.mtime = n.mtime)"))
def filt_retry(spark, sf):
    _, now = snapshots(spark, sf)
    failed = entries(spark, sf).where("id % 19 = 0").select("path", "mtime")
    return now.join(failed, ["path", "mtime"], "left_anti").select("path")


RELINK = """rows_ as (select name as rel, case when id % 4 = 0 then null else size end as size, mtime from entries where id % 3 <> 0),
list_ as (select name as rel, case when id % 10 = 1 then size + 1 when id % 10 = 2 then null else size end as size, mtime + (id % 5) * 900 as mtime from entries),
met as (select rel, r.mtime as own, l.mtime as listed, coalesce(r.mtime <> 0 and l.mtime <> 0 and r.mtime <> l.mtime and abs(r.mtime - l.mtime) <= 2000, false) as adopted
  from rows_ r join list_ l using (rel) where coalesce(r.size, 0) = 0 or coalesce(l.size, 0) = 0 or r.size = l.size)"""


def _relink(spark, sf):
    e = entries(spark, sf)
    rows = e.where("id % 3 <> 0").select(F.col("name").alias("rel"), F.expr("case when id % 4 = 0 then null else size end").alias("size"), "mtime")
    listing = e.select(F.col("name").alias("rel"), F.expr("case when id % 10 = 1 then size + 1 when id % 10 = 2 then null else size end").alias("size"), F.expr("mtime + (id % 5) * 900").alias("mtime"))
    return op.relink(rows, listing)


@query(sql("entries", "select rel, case when adopted then listed else own end as mtime, adopted from met where (select count(*) from met) >= 0.3 * (select count(*) from rows_)", RELINK))
def cdc_relink(spark, sf):
    return _relink(spark, sf)


@query(sql("entries", "select rel, listed as mtime from met where adopted", RELINK))
def join_tolerance(spark, sf):
    return _relink(spark, sf).where("adopted").select("rel", "mtime")


@query("select user_id as key, event_type as op, event_id as seq from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def cdc_coalesce(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"))
    return op.last_of(ev, "key", "seq").select("key", "op", "seq")


QUEUE = """jobs as (select user_id::varchar as path, case event_type when 'click' then 'a' when 'view' then 'b' when 'purchase' then 'b' else 'hi' end as lane, value > 40 as names, value % 2 < 1 as sounds, event_id as seq from events where event_id % 9 = 0)"""


@query(f"with {QUEUE} select path, coalesce(arg_min(lane, seq) filter (lane <> 'b'), 'b') as lane, coalesce(bool_or(names) filter (lane <> 'b'), arg_max(names, seq)) as names, coalesce(bool_or(sounds) filter (lane <> 'b'), arg_max(sounds, seq)) as sounds from jobs group by path")
def cdc_queue_merge(spark, sf):
    kind = F.col("event_type")
    lane = F.when(kind == "click", "a").when(kind.isin("view", "purchase"), "b").otherwise("hi")
    ev = table(spark, sf, "events").where("event_id % 9 = 0")
    return op.merge_queue(ev.select(F.col("user_id").cast("string").alias("path"), lane.alias("lane"), (F.col("value") > 40).alias("names"), (F.col("value") % 2 < 1).alias("sounds"), F.col("event_id").alias("seq")))


@query(sql("entries", "select path, lane, (row_number() over (partition by lane order by path) - 1) // 16 as chunk from (select path, case id % 3 when 0 then 'hi' when 1 then 'a' else 'b' end as lane from entries)"))
def sort_job_path(spark, sf):
    lane = F.when(F.col("id") % 3 == 0, "hi").when(F.col("id") % 3 == 1, "a").otherwise("b")
    return op.chunked(entries(spark, sf).select("path", lane.alias("lane")), 16)


@query("select user_id as path, event_id as seq, case when row_number() over (partition by user_id order by event_id) = 1 then 'retry' else 'failed' end as state from events where event_type = 'error'")
def cdc_crash_retry(spark, sf):
    """Errors stand for crashes of the worker on a user's file."""
    crashes = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"))
    return op.after_crash(crashes)


JOBS = """jobs as (select user_id as path, event_id as token from events where event_type in ('click', 'view')),
asked as (select user_id as path, event_id as seq, event_type, max(case when event_type in ('click', 'view') then event_id end) over (partition by user_id order by event_id) as token from events),
results as (select path, token, seq from asked where event_type not in ('click', 'view') and token is not null)"""


def _jobs(spark, sf):
    """Clicks and views ask for a job on a user's file; what comes after is an answer to the job that was asked for last then."""
    ev, asks = table(spark, sf, "events"), F.col("event_type").isin("click", "view")
    jobs = ev.where(asks).select(F.col("user_id").alias("path"), F.col("event_id").alias("token"))
    token = F.max(F.when(asks, F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("event_id"))
    return jobs, ev.select(F.col("user_id").alias("path"), token.alias("token"), F.col("event_id").alias("seq"), "event_type").where(~asks & F.col("token").isNotNull()).drop("event_type")


@query(f"with {JOBS} select r.path, r.token, min(seq) as seq from results r join (select path, max(token) as token from jobs group by path) using (path, token) group by all")
def cdc_token(spark, sf):
    jobs, results = _jobs(spark, sf)
    return op.accepted(results, jobs).select("path", "token", "seq")


@query(f"with {JOBS} select path, count(*) as asked, count(*) - 1 as superseded, max(token) as answered from jobs group by path")
def str_supersede(spark, sf):
    """A newer request cancels the older ones of its file: how many, and the one that is answered."""
    jobs, _ = _jobs(spark, sf)
    return jobs.groupBy("path").agg(F.count("*").alias("asked"), (F.count("*") - 1).alias("superseded"), F.max("token").alias("answered"))


@query("select key, case when key = 'gen' then (value::bigint + 1)::varchar else value end as value from (select n_name as key, n_nationkey::varchar as value from nation union all select 'gen', (select count(*) from nation)::varchar)")
def sql_gen_bump(spark, sf):
    n = table(spark, sf, "nation")
    meta = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return op.bump(meta.union(n.agg(F.count("*").cast("string").alias("value")).select(F.lit("gen"), "value")))


@query(sql("entries", "select e.id, e.path, coalesce(n.size, e.size) as size, e.mtime from entries e left join (select path, case when id % 5 = 0 then null else size + 100 end as size, case when id % 2 = 0 then mtime else mtime + 1 end as mtime from entries where id % 3 = 0) n on n.path = e.path and n.mtime = e.mtime"))
def sql_update_where(spark, sf):
    """Sizes of files that are still as they were: only rows with the same path and time change."""
    e = entries(spark, sf).select("id", "path", "size", "mtime")
    news = e.where("id % 3 = 0").select("path", F.expr("case when id % 5 = 0 then null else size + 100 end").alias("size"), F.expr("case when id % 2 = 0 then mtime else mtime + 1 end").alias("mtime"))
    return op.update_where(e, news, ["path", "mtime"], ["size"])


INSERTS = """old_ as (select id % 50 as key, max(id) as v from entries where id % 2 = 0 group by all),
new_ as (select id % 75 as key, id as v from entries where id % 3 = 0)"""


def _inserts(spark, sf):
    e = entries(spark, sf)
    old = e.where("id % 2 = 0").groupBy((F.col("id") % 50).alias("key")).agg(F.max("id").alias("v"))
    return old, e.where("id % 3 = 0").select((F.col("id") % 75).alias("key"), F.col("id").alias("v"), F.col("id").alias("at"))


@query(sql("entries", "select key, v from old_ union all select key, min(v) from new_ where key not in (select key from old_) group by key", INSERTS))
def sql_insert_ignore(spark, sf):
    return op.insert(*_inserts(spark, sf), "key", "at", replace=False)


@query(sql("entries", "select key, max(v) as v from new_ group by key union all select key, v from old_ where key not in (select key from new_)", INSERTS))
def sql_insert_replace(spark, sf):
    return op.insert(*_inserts(spark, sf), "key", "at", replace=True)


UP = """old_ as (select id, path, size, mtime from entries where id % 2 = 0),
new_ as (select path, case when id % 5 = 0 then null else size + 1 end as size, mtime + 5 as mtime from entries where id % 3 = 0)"""


@query(sql("entries", "select o.id, coalesce(o.path, n.path) as path, coalesce(n.size, o.size) as size, case when n.path is not null then n.mtime else o.mtime end as mtime from old_ o full join new_ n on o.path = n.path", UP))
def dml_upsert(spark, sf):
    e = entries(spark, sf)
    news = e.where("id % 3 = 0").select("path", F.expr("case when id % 5 = 0 then null else size + 1 end").alias("size"), F.expr("mtime + 5").alias("mtime"), F.lit(True).alias("_new"))
    return op.upsert(e.where("id % 2 = 0").select("id", "path", "size", "mtime"), news, "path", ["size"])


@query(sql("entries", "select o.id, coalesce(o.path, n.path) as path, coalesce(n.size, o.size) as size, case when n.path is not null then n.mtime else o.mtime end as mtime, case when n.path is not null then (select max(id % 9) from old_) + 1 else o.id % 9 end as gen from old_ o full join new_ n on o.path = n.path", UP))
def sink_vectors(spark, sf):
    """A batch put in by path: one new generation for all of it."""
    e = entries(spark, sf)
    news = e.where("id % 3 = 0").select("path", F.expr("case when id % 5 = 0 then null else size + 1 end").alias("size"), F.expr("mtime + 5").alias("mtime"))
    return op.write_batch(e.where("id % 2 = 0").select("id", "path", "size", "mtime", (F.col("id") % 9).alias("gen")), news, "path", ["size"])


@query(sql("entries", "select id, path from entries where id % 6 <> 0"))
def dml_delete(spark, sf):
    """By id: copies of a file may share a path with one that goes."""
    e = entries(spark, sf)
    return e.join(e.where("id % 6 = 0").select("id"), "id", "left_anti").select("id", "path")


@query(sql("entries", "select arg_max(id, (moved, -id)) as id, path from (select id, id % 2 as moved, case when id % 2 = 1 then 'all/' || (id % 300)::varchar else 'all/' || id::varchar end as path from entries) group by path"))
def dml_rename(spark, sf):
    moved = F.col("id") % 2
    e = entries(spark, sf).select("id", moved.alias("moved"), F.concat(F.lit("all/"), F.when(moved == 1, F.col("id") % 300).otherwise(F.col("id")).cast("string")).alias("path"))
    return e.groupBy("path").agg(F.max_by("id", F.struct("moved", -F.col("id"))).alias("id"))


@query(sql("entries", "select coalesce(o.path, n.path) as path, coalesce(n.mtime, o.mtime) as mtime, (case when n.mtime is null then o.attempts when n.mtime = o.mtime then o.attempts + 1 else 1 end)::bigint as attempts from (select path, mtime, id % 4 as attempts from entries where id % 2 = 0) o full join (select path, case when id % 5 = 0 then mtime + 1 else mtime end as mtime from entries where id % 3 = 0) n on o.path = n.path"))
def agg_int_attempts(spark, sf):
    e = entries(spark, sf)
    return op.attempts(e.where("id % 2 = 0").select("path", "mtime", (F.col("id") % 4).alias("attempts")), e.where("id % 3 = 0").select("path", F.expr("case when id % 5 = 0 then mtime + 1 else mtime end").alias("mtime")))


MOVES = "moves(src, dst) as (values ('Brand#1', 'New/One'), ('Brand#1/ECONOMY', 'Eco'), ('Brand#2/SMALL', 'Tiny'))"


@query(sql("entries", "select path, case when path like 'Brand#1/ECONOMY/%' then 'Eco' || substr(path, 16) when path like 'Brand#1/%' then 'New/One' || substr(path, 8) when path like 'Brand#2/SMALL/%' then 'Tiny' || substr(path, 14) else path end as new_path from entries"))
def cdc_remap(spark, sf):
    moves = spark.createDataFrame([("Brand#1", "New/One"), ("Brand#1/ECONOMY", "Eco"), ("Brand#2/SMALL", "Tiny")], "src string, dst string")
    return op.remap(entries(spark, sf).select("path"), moves).select("path", "new_path")


@query(sql("entries", "select path, src from entries join moves on path like src || '/%'", MOVES))
def join_theta_prefix(spark, sf):
    moves = spark.createDataFrame([("Brand#1",), ("Brand#1/ECONOMY",), ("Brand#2/SMALL",)], "src string")
    parts = F.split("path", "/")
    p = entries(spark, sf).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("src"))
    return p.join(moves, "src").select("path", "src")


@query(sql("entries vectors", "select e.id, e.name, v.label from entries e join vectors v using (id)"))
def join_inner_hash(spark, sf):
    return entries(spark, sf).join(vectors(spark, sf), "id").select("id", "name", "label")


@query(sql("entries vectors", "select v.id, v.label, e.name from vectors v left join entries e using (id)"))
def join_left_outer(spark, sf):
    return vectors(spark, sf).join(entries(spark, sf).select("id", "name"), "id", "left").select("id", "label", "name")


@query(sql("entries vectors", "select e.id, v.label, v.id is null as unscored from entries e left join vectors v using (id)"))
def join_left_score(spark, sf):
    v = vectors(spark, sf).select(F.col("id").alias("vid"), "label")
    return entries(spark, sf).join(v, F.col("id") == F.col("vid"), "left").select("id", "label", F.col("vid").isNull().alias("unscored"))


@query(sql("entries vectors", "select id, label from vectors where id in (select id from entries)"))
def join_semi(spark, sf):
    return vectors(spark, sf).join(entries(spark, sf).select("id"), "id", "left_semi").select("id", "label")


@query(sql("entries vectors", "select id, name from entries where id not in (select id from vectors where label = 3)"))
def join_anti(spark, sf):
    return entries(spark, sf).join(vectors(spark, sf).where("label = 3").select("id"), "id", "left_anti").select("id", "name")


@query(sql("entries", "select term, id from (select unnest(string_split(split_part(name, '.', 1), ' ')) as term, id % 40 as id from entries) group by all"))
def join_inverted(spark, sf):
    return entries(spark, sf).select(F.explode(F.split(F.split("name", r"\.")[0], " ")).alias("term"), (F.col("id") % 40).alias("id")).distinct()


@query(sql("entries", "select id, gen from (select id, mtime / 1000 as gen from entries) where gen > 120"))
def sql_gen_replay(spark, sf):
    return entries(spark, sf).select("id", (F.col("mtime") / 1000).alias("gen")).where("gen > 120")


@query(sql("entries", "select id, name from entries where id > 50 order by id limit 100"))
def scan_sqlite_page(spark, sf):
    return entries(spark, sf).where("id > 50").orderBy("id").limit(100).select("id", "name")


@query(sql("entries vectors", "select (select count(*) from entries) as files, (select count(*) from vectors) as vectors, (select count(*) from entries where id not in (select id from vectors)) as pending, case when (select count(*) from entries where id not in (select id from vectors)) = 0 then 'ready' else 'indexing' end as phase"))
def q_status(spark, sf):
    e, v = entries(spark, sf).select("id"), vectors(spark, sf).select("id")
    one = e.agg(F.count("*").alias("files")).join(v.agg(F.count("*").alias("vectors"))).join(e.join(v, "id", "left_anti").agg(F.count("*").alias("pending")))  # three single rows
    return one.withColumn("phase", F.when(F.col("pending") == 0, "ready").otherwise("indexing"))


IMPORT = """src as (select id, dir as folder, split_part(name, ' ', 2) || '.wav' as name, size from entries where id % 4 <> 0),
lst as (select dir as folder, split_part(name, ' ', 2) || case id % 12 when 0 then '' when 4 then ' (2)' else ' (3)' end || '.wav' as name, min(size) as size, split_part(name, ' ', 2) as base, case id % 12 when 0 then 1 when 4 then 2 else 3 end as no from entries where id % 4 = 0 group by all),
used as (select folder, base || '.wav' as name, list_sort(list(distinct no)) as taken from lst group by all),
first_ as (select folder, name, arg_min(size, id) as first_size, min(id) as first_id from src group by all),
met as (select s.*, l.size as l_size, coalesce(taken, []) as taken, not (l.size is null and s.id = first_id) and s.size = coalesce(l.size, first_size) as skip
  from src s join first_ f using (folder, name) left join lst l on l.folder = s.folder and l.name = s.name left join used u on u.folder = s.folder and u.name = s.name),
ranked as (select *, row_number() over (partition by folder, name, skip order by id) as r from met),
placed as (select *, list_reduce(list_prepend(r, taken), lambda n, t: case when t <= n then n + 1 else n end) as no from ranked)"""


@query(sql("entries", "select id, case when skip then 'skip' when no = 1 then name else replace(name, '.wav', ' (' || no || ').wav') end as result from placed", IMPORT))
def dml_import(spark, sf):
    """Files that come into folders where some of their names and numbers are taken."""
    e = entries(spark, sf).select("id", F.col("dir").alias("folder"), F.split("name", " ")[1].alias("base"), "size")
    suffix = F.when(F.col("id") % 12 == 0, "").when(F.col("id") % 12 == 4, " (2)").otherwise(" (3)")
    listing = e.where("id % 4 = 0").select("folder", F.concat("base", suffix, F.lit(".wav")).alias("name"), "size").groupBy("folder", "name").agg(F.min("size").alias("size"))
    return op.imported(e.where("id % 4 <> 0").select("id", "folder", F.concat("base", F.lit(".wav")).alias("name"), "size"), listing)
