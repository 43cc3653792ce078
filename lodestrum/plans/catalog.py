"""Queries over the file listing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.functions import text as tx
from lodestrum.operators import catalog as op
from lodestrum.plans.registry import query
from lodestrum.sources.tables import entries, sql, table

PATHS = "select doc_id as id, case doc_id % 6 when 0 then 'a/b/c ' || doc_id || '.wav' when 1 then 'x/node_modules/d.WAV' when 2 then '~$tmp.wav' when 3 then 'm/.git/e.wav' when 4 then 'q/r.mp3' else 'solo' || doc_id || '.Wav' end as path from documents"


def _paths(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    path = F.when(k == 0, F.concat(F.lit("a/b/c "), i, F.lit(".wav"))).when(k == 1, "x/node_modules/d.WAV").when(k == 2, "~$tmp.wav").when(k == 3, "m/.git/e.wav").when(k == 4, "q/r.mp3").otherwise(F.concat(F.lit("solo"), i, F.lit(".Wav")))
    return d.select(F.col("doc_id").alias("id"), path.alias("path"))


LEAF = "regexp_extract(path, '[^/]*$')"


@query(f"select id, path from ({PATHS}) where lower({LEAF}) like '%.wav' and {LEAF} not like '~$%'")
def scan_filter_ext(spark, sf):
    return _paths(spark, sf).where(op.is_audio(F.element_at(F.split("path", "/"), -1)))


@query(f"select id, path from ({PATHS}) where not list_has_any(string_split(lower(path), '/'), ['node_modules', '.git', '$recycle.bin', 'system volume information'])")
def scan_filter_dir(spark, sf):
    return _paths(spark, sf).where(~op.has_ignored_dir(F.col("path")))


@query("select vec_id as id, label::bigint as label from embeddings")
def scan_sqlite_meta(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))


@query(f"select id, {LEAF} as name, case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end as dir, case when path like '%/%' then split_part(path, '/', 1) else '' end as top_level from ({PATHS})")
def proj_entry(spark, sf):
    return _paths(spark, sf).select("id", *op.split_path(F.col("path")))


@query("""
with h as (select doc_id as id, n_chars as size, case doc_id % 7 when 0 then 'bytes=0-99' when 1 then 'bytes=-50' when 2 then 'bytes=10-' when 3 then 'bytes=-' when 4 then 'items=1-2' when 5 then 'bytes=9999999-' else 'bytes=5-2' end as header from documents),
p as (select *, regexp_extract(header, '^bytes=(\\d*)-(\\d*)$', 1) as a, regexp_extract(header, '^bytes=(\\d*)-(\\d*)$', 2) as b, regexp_matches(header, '^bytes=(\\d*)-(\\d*)$') as ok from h),
r as (select *, case when a = '' then greatest(0, size - try_cast(b as bigint)) else try_cast(a as bigint) end as s, case when a = '' or b = '' then size - 1 else least(try_cast(b as bigint), size - 1) end as e from p)
select id, case when not ok or (a = '' and b = '') then 'none' when s > e or s >= size then 'invalid' else 'ok' end as status,
       case when ok and not (a = '' and b = '') and s <= e and s < size then s end as first_byte,
       case when ok and not (a = '' and b = '') and s <= e and s < size then e end as last_byte from r""")
def scan_range_http(spark, sf):
    k, size = F.col("doc_id") % 7, F.col("n_chars")
    header = F.when(k == 0, "bytes=0-99").when(k == 1, "bytes=-50").when(k == 2, "bytes=10-").when(k == 3, "bytes=-").when(k == 4, "items=1-2").when(k == 5, "bytes=9999999-").otherwise("bytes=5-2")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), size.alias("size"), header.alias("header"))
    form = r"^bytes=(\d*)-(\d*)$"
    a, b = F.regexp_extract("header", form, 1), F.regexp_extract("header", form, 2)
    first = F.when(a == "", F.greatest(F.lit(0), F.col("size") - b.try_cast("long"))).otherwise(a.try_cast("long"))
    last = F.when((a == "") | (b == ""), F.col("size") - 1).otherwise(F.least(b.try_cast("long"), F.col("size") - 1))
    d = d.withColumns({"has": F.col("header").rlike(form) & ~((a == "") & (b == "")), "s": first, "e": last})
    good = F.col("has") & (F.col("s") <= F.col("e")) & (F.col("s") < F.col("size"))
    return d.select("id", F.when(~F.col("has"), "none").when(good, "ok").otherwise("invalid").alias("status"), F.when(good, F.col("s")).alias("first_byte"), F.when(good, F.col("e")).alias("last_byte"))


@query(sql("entries", "select dir, list_sort(list(name)) as names, count(*) as n from entries group by dir"))
def sink_library(spark, sf):
    return entries(spark, sf).groupBy("dir").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count("*").alias("n"))


@query(sql("entries", "select id, name, dense_rank() over (order by first) - 1 as dir_code from (select *, min(id) over (partition by dir) as first from entries)"))
def sink_packed(spark, sf):
    return op.pack(entries(spark, sf))


@query(sql("entries", "select id, path from entries"))
def sink_packed_unpack(spark, sf):
    e = entries(spark, sf)
    packed = op.pack(e)
    dirs = e.join(packed.select("id", "dir_code"), "id").groupBy("dir_code").agg(F.first("dir").alias("dir"))
    return packed.join(dirs, "dir_code").select("id", F.concat("dir", F.lit("/"), "name").alias("path"))


@query(sql("entries", "select key, min(id) as id from (select md5(dir || size::varchar) as key, id from entries) group by key"))
def sink_render(spark, sf):
    return entries(spark, sf).select(F.md5(F.concat("dir", F.col("size").cast("string"))).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))


@query(sql("entries", "select id, path from entries where lower(dir) = 'brand#1' or lower(dir) like 'brand#1/%'"))
def filt_folder(spark, sf):
    return entries(spark, sf).where(op.in_folder(F.col("dir"), "/Brand#1/")).select("id", "path")


@query(sql("entries", "select id, path from entries where path = 'Brand#2' or path like 'Brand#2/%'"))
def filt_under_root(spark, sf):
    return entries(spark, sf).where(op.under_root(F.col("path"), "Brand#2")).select("id", "path")


@query(sql("entries shelves", "select e.id, e.path from entries e where e.path in (select path from shelves where vault = 1)"))
def filt_scope(spark, sf):
    from lodestrum.sources.tables import shelves

    return entries(spark, sf).join(shelves(spark, sf).where("vault = 1").select("path"), "path", "left_semi").select("id", "path")


@query(sql("entries shelves", "select s.collection, s.pos, e.id, e.name from shelves s join entries e using (path)"))
def filt_resolve(spark, sf):
    from lodestrum.sources.tables import shelves

    return op.resolve(entries(spark, sf), shelves(spark, sf)).select("collection", "pos", "id", "name")


@query(sql("entries", "select id, name from entries where path not in (select path from entries where size % 5 = 0)"))
def filt_exclude(spark, sf):
    e = entries(spark, sf)
    return e.join(e.where("size % 5 = 0").select("path"), "path", "left_anti").select("id", "name")


NAMES = "select id, case id % 9 when 0 then name when 1 then ' ' || name when 2 then '' when 3 then '..' when 4 then 'a?b' when 5 then 'end.' when 6 then 'CON.txt' when 7 then repeat('n', 201) else null end as name from entries"


def _names(spark, sf):
    k = F.col("id") % 9
    pick = F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.lit(" "), "name")).when(k == 2, "").when(k == 3, "..").when(k == 4, "a?b").when(k == 5, "end.").when(k == 6, "CON.txt").when(k == 7, F.lit("n" * 201))
    return entries(spark, sf).select("id", pick.alias("name"))


@query(sql("entries", f"""select id, case when name is null or trim(name) = '' then 'required' when trim(name) <> name then 'spaces' when name in ('.', '..') then 'invalid'
 when regexp_matches(name, '[<>:"/\\\\|?*]') then 'characters' when regexp_matches(name, '[. ]$') then 'ending' when regexp_matches(lower(name), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$') then 'reserved'
 when length(name) > 200 then 'long' end as error from ({NAMES})"""))
def filt_name_valid(spark, sf):
    return _names(spark, sf).select("id", op.name_error(F.col("name")).alias("error"))


@query(sql("entries", f"select id, case when name is null or trim(name) = '' then 'required' when trim(name) = '__colors' then 'reserved' when length(trim(name)) > 80 then 'long' end as error from ({NAMES})"))
def filt_coll_name_valid(spark, sf):
    return _names(spark, sf).select("id", op.collection_name_error(F.col("name")).alias("error"))


@query(sql("entries", """, d as (select dir, count(*) as n from entries group by dir)
select rel, case when depth > 1 then regexp_replace(rel, '/[^/]*$', '') else '' end as parent, depth, sum(n)::bigint as files, sum(case when rel = dir then n else 0 end)::bigint as direct
from (select dir, n, unnest([1, 2])::bigint as depth, unnest([split_part(dir, '/', 1), dir]) as rel from d) group by rel, depth""".replace(", d as", "", 1).replace("(select dir, count(*) as n from entries group by dir)\n", "", 1).replace("from d)", "from (select dir, count(*) as n from entries group by dir))")))
def agg_tree_count(spark, sf):
    return op.folder_tree(entries(spark, sf))


@query(sql("entries", "select top_level, count(*) as files, sum(size)::bigint as bytes, max(mtime) as newest from entries group by top_level"))
def agg_count(spark, sf):
    return entries(spark, sf).groupBy("top_level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest"))


@query(sql("entries", "select count(*) as files, sum(size)::bigint as bytes from entries"))
def agg_renders_stats(spark, sf):
    return entries(spark, sf).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def sql_natural(x: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all(strip_accents(lower({x})), '\\d+|\\D+'), lambda p: case when regexp_matches(p, '^\\d') then lpad(p, 12, '0') else p end), 'string_agg', '')"


RANKED = "select row_number() over (order by {0}) - 1 as rank, id from entries"


@query(sql("entries", RANKED.format(f"{sql_natural('name')}, {sql_natural('dir')}, id")))
def sort_name(spark, sf):
    return op.ranked(entries(spark, sf), op.natural_key(F.col("name")), op.natural_key(F.col("dir")), F.col("id"))


@query(sql("entries", RANKED.format(f"mtime desc, {sql_natural('name')}, id")))
def sort_date(spark, sf):
    return op.ranked(entries(spark, sf), -F.col("mtime"), op.natural_key(F.col("name")), F.col("id"))


@query(sql("entries", RANKED.format(f"size desc, {sql_natural('name')}, id")))
def sort_size(spark, sf):
    return op.ranked(entries(spark, sf), -F.col("size"), op.natural_key(F.col("name")), F.col("id"))


@query(sql("entries", RANKED.format(f"{sql_natural('dir')}, {sql_natural('name')}, id")))
def sort_path(spark, sf):
    return op.ranked(entries(spark, sf), op.natural_key(F.col("dir")), op.natural_key(F.col("name")), F.col("id"))


@query(sql("entries", "select id, list_aggregate(list_transform(regexp_extract_all(lower(x), '\\d+|\\D+'), lambda p: case when regexp_matches(p, '^\\d') then lpad(p, 12, '0') else p end), 'string_agg', '') as key from (select id, 'x ' || id::varchar || ' B' || (id % 12)::varchar as x from entries)"))
def sort_natural(spark, sf):
    x = F.concat(F.lit("x "), F.col("id").cast("string"), F.lit(" B"), (F.col("id") % 12).cast("string"))
    return entries(spark, sf).select("id", op.natural_key(x).alias("key"))


@query(sql("entries", f"select rank, id from ({RANKED.format('size desc, mtime desc, name')}) where rank < 50"))
def topk_heap(spark, sf):
    keys = (F.desc("size"), F.desc("mtime"), "name")
    top = entries(spark, sf).orderBy(*keys).limit(50)
    return top.select((F.row_number().over(Window.orderBy(*keys)) - 1).cast("long").alias("rank"), "id")


@query(sql("entries", "select id, lower(p) || case when k = 1 then '.wav' else ' (' || k || ').wav' end as name from (select id, split_part(name, ' ', 1) as p, row_number() over (partition by lower(split_part(name, ' ', 1)) order by id) as k from entries)"))
def fn_unique_name(spark, sf):
    e = entries(spark, sf).select("id", F.concat(F.lower(F.split("name", " ")[0]), F.lit(".wav")).alias("name"))
    return op.unique_names(e).select("id", F.col("unique_name").alias("name"))


@query(sql("entries", "select id, case when dir = 'Brand#1' then '' when dir like 'Brand#1/%' then replace(substr(dir, 9), '/', ' › ') else replace(dir, '/', ' › ') end as shown from entries"))
def fn_reldir(spark, sf):
    d = F.col("dir")
    return entries(spark, sf).select("id", F.when(d == "Brand#1", "").when(d.startswith("Brand#1/"), F.replace(F.substring(d, 9, 1 << 20), F.lit("/"), F.lit(" › "))).otherwise(F.replace(d, F.lit("/"), F.lit(" › "))).alias("shown"))
