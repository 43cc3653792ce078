"""Queries over signals and feature frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.operators import series as op
from lodestrum.plans.registry import query
from lodestrum.session import ship
from lodestrum.sources import wav
from lodestrum.sources.tables import frames, samples, sql, table

B = 16
SIZES = "sizes as (select series, count(*) as n from samples group by series)"
PEAKS = f"peaks_ as (select series, floor(i * {B}.0::double / n)::bigint as bucket, least(max(abs(x)), 1.0) as peak, sqrt(avg(x * x)) as rms from samples join sizes using (series) group by all)"


@query(sql("samples", "select series, bucket, round(peak, 6) as peak, round(rms, 6) as rms from peaks_", SIZES, PEAKS))
def agg_peak_rms(spark, sf):
    return op.peaks(samples(spark, sf), B).select("series", "bucket", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


@query(sql("samples", "select series, bucket, round(last_value(peak ignore nulls) over w, 6) as peak, round(last_value(rms ignore nulls) over w, 6) as rms from (select series, unnest(range(0, 16)) as bucket from sizes) left join (select * from peaks_ where bucket % 3 <> 1) using (series, bucket) window w as (partition by series order by bucket rows between unbounded preceding and current row)", SIZES, PEAKS))
def agg_fillgaps(spark, sf):
    parts = op.peaks(samples(spark, sf), B).where("bucket % 3 <> 1")
    return op.fill_gaps(parts, B).select("series", "bucket", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


@query(sql("samples", "select series, level, i // (8 * (1 << level)) as block, round(min(x), 6) as lo, round(max(x), 6) as hi, round(sum(x * x), 4) as sq from samples, (select unnest(range(0, 4)) as level) group by all"))
def agg_pyramid(spark, sf):
    return op.pyramid(samples(spark, sf), 8, 4).select("series", "level", "block", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("sq", 4).alias("sq"))


@query(sql("samples", "select series, round(min(x), 6) as lo, round(max(x), 6) as hi, round(sum(x * x), 4) as sq, count(*) as n from samples where i >= 3 and i < 41 group by series"))
def agg_range_stats(spark, sf):
    return op.range_stats(samples(spark, sf), 3, 41).select("series", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("sq", 4).alias("sq"), "n")


@query(sql("samples", "select series, 11 - c as slice, round(min(x), 6) as lo, round(max(x), 6) as hi, round(sqrt(avg(x * x)), 6) as rms from samples join sizes using (series), (select unnest(range(0, 12)) as c) where i >= floor(c * n::double / 12) and i < greatest(floor(c * n::double / 12) + 1, floor((c + 1) * n::double / 12)) group by series, c", SIZES))
def agg_columns(spark, sf):
    return op.columns(samples(spark, sf), 12, reverse=True).select("series", "slice", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("rms", 6).alias("rms"))


def sql_delta(src: str, col: str, name: str) -> str:
    at = lambda k: f"coalesce({'lead' if k > 0 else 'lag'}({col}, {abs(k)}) over w, {'last' if k > 0 else 'first'}_value({col}) over all_)"
    return f"{name} as (select *, (({at(1)} - {at(-1)}) + 2 * ({at(2)} - {at(-2)})) / 10 as {name}_v from {src} window w as (partition by series order by w), all_ as (partition by series order by w rows between unbounded preceding and unbounded following))"


@query(sql("frames", "select series, w, round(d1_v, 6) as d from d1", sql_delta("frames", "f0", "d1")))
def win_delta(spark, sf):
    return op.delta(frames(spark, sf), "f0").select("series", "w", F.round("d", 6).alias("d"))


@query(sql("frames", "select series, w, round(d2_v, 6) as dd from d2", sql_delta("frames", "f0", "d1"), sql_delta("d1", "d1_v", "d2")))
def win_deltadelta(spark, sf):
    return op.delta(op.delta(frames(spark, sf), "f0"), "d", name="dd").select("series", "w", F.round("dd", 6).alias("dd"))


LOUD = f"f0 >= {op.QUIET}"
SUMS = f"sums as (select series, count(*) filter ({LOUD}) as counted, " + ", ".join(f"coalesce(sum(f{d}) filter ({LOUD}), 0) as s{d}, coalesce(sum(f{d} * f{d}) filter ({LOUD}), 0) as q{d}" for d in range(4)) + ", arg_max([f0, f1, f2, f3], (f0, -w)) as attack from frames group by series)"
STATS = "tot as (select sum(counted) as n, " + ", ".join(f"sum(s{d}) as s{d}, sum(q{d}) as q{d}" for d in range(4)) + " from sums where counted >= 2),\nstats as (select " + ", ".join(f"s{d} / n as m{d}, case when sqrt(greatest(0, q{d} / n - (s{d} / n) * (s{d} / n))) <= 1e-6 then 1 else sqrt(greatest(0, q{d} / n - (s{d} / n) * (s{d} / n))) end as t{d}" for d in range(4)) + " from tot)"
ZF = "zraw as (select series, w, f0, [" + ", ".join(f"(f{d} - m{d}) / t{d}" for d in range(4)) + "] as v from frames, stats),\nzf as (select series, w, f0, list_transform(v, lambda x: case when list_dot_product(v, v) > 0 then x / sqrt(list_dot_product(v, v)) else 0 end) as z from zraw)"


@query(sql("frames", "select series, counted, round(s0, 6) as s0, round(q0, 6) as q0, round(s1, 6) as s1, round(q1, 6) as q1 from sums", SUMS))
def agg_sums_partial(spark, sf):
    return op.partial_sums(frames(spark, sf)).select("series", "counted", *(F.round(c, 6).alias(c) for c in ("s0", "q0", "s1", "q1")))


@query(sql("frames", "select (sum(counted) - sum(counted) filter (series % 5 = 0))::bigint as n, round(sum(s0) - sum(s0) filter (series % 5 = 0), 4) as s0, round(sum(q1) - sum(q1) filter (series % 5 = 0), 2) as q1 from sums where counted >= 2", SUMS))
def agg_sums_final(spark, sf):
    parts = op.partial_sums(frames(spark, sf)).where("counted >= 2")
    signed = parts.withColumn("sign", F.lit(1)).union(parts.where("series % 5 = 0").withColumn("sign", F.lit(-1)))
    return signed.agg(F.sum(F.col("counted") * F.col("sign")).alias("n"), F.round(F.sum(F.col("s0") * F.col("sign")), 4).alias("s0"), F.round(F.sum(F.col("q1") * F.col("sign")), 2).alias("q1"))


@query(sql("frames", "select " + ", ".join(f"round(m{d}, 6) as m{d}, round(t{d}, 6) as t{d}" for d in range(4)) + " from stats", SUMS, STATS))
def agg_mean_std(spark, sf):
    s = op.final_stats(op.partial_sums(frames(spark, sf)))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query(sql("frames", "select series, arg_max(w, (f0, -w)) as w, max(f0) as f0 from frames group by series"))
def agg_argmax_frame(spark, sf):
    return frames(spark, sf).groupBy("series").agg(F.max_by("w", F.struct("f0", -F.col("w"))).alias("w"), F.max("f0").alias("f0"))


def sql_half(x: str) -> str:
    """A number that isn't negative as the hex digits of a 16-bit float, the low byte first."""
    power = f"greatest(floor(log2({x})), -14)::int"
    # What is rounded up to the next power goes on into the exponent; below 2 ** -14 there is none.
    bits = f"(case when {x} < 6e-8 then 0 else ({power} + 14) * 1024 + round_even({x} / pow(2, {power}) * 1024, 0)::int end)::int"
    return f"lpad(to_hex({bits} & 255), 2, '0') || lpad(to_hex({bits} >> 8), 2, '0')"


HASH = f"md5(from_hex(string_agg({' || '.join(sql_half(f'f{d}') for d in range(4))}, '' order by w)))"


@query(sql("frames", f"select series, {HASH} as hash from frames group by series"))
def agg_hash(spark, sf):
    """The content of each series, by all numbers of its frames as 16-bit floats."""
    ship(spark)
    return op.content_hashes(op.whole_series(frames(spark, sf)))


@query(sql("frames", "select series, w, list_transform(z, lambda x: round(x, 6)) as z from zf", SUMS, STATS, ZF))
def win_zspace(spark, sf):
    f = frames(spark, sf)
    return op.z_frames(f, op.final_stats(op.partial_sums(f))).select("series", "w", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


def sql_slide(frames_of_query: int) -> str:
    """sl(series, off, score, swapped, span): the first series' first frames, looked for in every series."""
    return f"""qf as (select w as qw, z as qz, {LOUD} as loud from zf where series = (select min(series) from zf) and w < {frames_of_query}),
qn as (select count(*) as qn, count(*) filter (loud) as ql from qf),
cn as (select series, count(*) as n, count(*) filter ({LOUD}) as cl from zf group by series),
al as (select c.series, c.w - qw as off_, sum(list_dot_product(c.z, qz)) / any_value(ql) as s from zf c join cn using (series), qf, qn where n >= qn and loud and c.w - qw between 0 and n - qn group by all
  union all select c.series, qw - c.w as off_, sum(list_dot_product(c.z, qz)) / any_value(cl) as s from zf c join cn using (series), qf, qn where n < qn and c.{LOUD} and qw - c.w between 0 and qn - n group by all),
ba as (select series, off_, round(s, 9) as s from al qualify row_number() over (partition by series order by round(s, 9) desc, off_) = 1),
sl as (select series, case when n < qn then 0 else coalesce(off_, 0) end as off, coalesce(s, -1) * case when n < qn then n / qn::double else 1 end as score, n < qn as swapped, n as span from cn left join ba using (series), qn)"""


def summaries(f):
    """Partial sums of every series and the statistics over all. Each frame's place is asked for in both uses of the frames, so
    that the planner makes their shuffle once."""
    sums = op.partial_sums(f)
    return sums, op.final_stats(sums)


def _slide(spark, sf, length):
    f = frames(spark, sf).where("w >= 0")
    sums, stats = summaries(f)
    rows = op.whole_series(f)
    query = rows.orderBy("series").limit(1).select(F.slice("flat", 1, length * op.DIMS).alias("flat"))
    return op.slide(query, rows, stats)


@query(sql("frames", "select series, off, round(score, 6) as score, swapped from sl", SUMS, STATS, ZF, sql_slide(60)))
def win_sliding_match(spark, sf):
    """Sixty frames: some series are shorter, and slide over them."""
    return _slide(spark, sf, 60).select("series", "off", F.round("score", 6).alias("score"), "swapped")


@query(sql("frames", "select series, round(score, 6) as score, round(greatest(0, least(1, (score - 0.904) / (1 - 0.904))), 6) as confidence from sl order by sl.score desc, series limit 20", SUMS, STATS, ZF, sql_slide(4)))
def q_echo_fine(spark, sf):
    top = _slide(spark, sf, 4).orderBy(F.desc("score"), "series").limit(20)
    return top.select("series", F.round("score", 6).alias("score"), F.round(op.confidence(F.col("score"), F.lit(150.0)), 6).alias("confidence"))


@query(sql("frames", "select series, off, round(score, 6) as score from sl order by sl.score desc, series limit 12", SUMS, STATS, ZF, sql_slide(20)))
def topk_running(spark, sf):
    """The best twelve, of which each task keeps its own while it reads."""
    f = frames(spark, sf).where("w >= 0")
    _, stats = summaries(f)
    rows = op.whole_series(f)
    query = rows.orderBy("series").limit(1).select(F.slice("flat", 1, 20 * op.DIMS).alias("flat"))
    return op.slide(query, rows, stats, best=12).orderBy(F.desc("score"), "series").limit(12).select("series", "off", F.round("score", 6).alias("score"))


PCM = "pcm as (select series, i, case when x >= 1 then 32767 when x <= -1 then -32768 when x < 0 then floor(x * 32768 + 0.5) else floor(x * 32767 + 0.5) end / 32768 as y from samples)"


def _files(spark, sf):
    """A WAV file of each signal: path, content."""
    ship(spark)
    one = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    rows = samples(spark, sf).groupBy("series").agg(one.alias("xs")).select(F.col("series").cast("string").alias("path"), "xs")
    return wav.encoded(rows, 8000)


@query(sql("samples", "select series::varchar as path, 44 + 2 * count(*) as bytes from samples group by series"))
def sink_wav(spark, sf):
    return _files(spark, sf).select("path", F.octet_length("content").cast("long").alias("bytes"))


@query(sql("samples", "select series::varchar as path, 8000::int as rate, 1::int as channels, 16::int as bits, 1::int as format, 44::bigint as data_at, 2 * count(*) as data_bytes, count(*) as frames from samples group by series"))
def scan_wav_header(spark, sf):
    return wav.headers(_files(spark, sf))


@query(sql("samples", "select series::varchar as path, i, round(y, 6) as y from pcm", PCM))
def scan_wav_pcm(spark, sf):
    d = wav.samples(_files(spark, sf)).select("path", F.posexplode("samples").alias("i", "y"))
    return d.select("path", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


@query(sql("samples", "select series, round(count(*) filter (x >= 0 and p < 0 or x < 0 and p >= 0)::double / (count(*) - 1), 6) as zcr from (select series, x, lag(x) over (partition by series order by i) as p from samples) group by series having count(*) > 1"))
def win_zcr(spark, sf):
    w = Window.partitionBy("series").orderBy("i")
    x = samples(spark, sf).withColumn("p", F.lag("x").over(w))
    cross = ((F.col("x") >= 0) & (F.col("p") < 0)) | ((F.col("x") < 0) & (F.col("p") >= 0))
    return x.groupBy("series").agg(F.count("*").alias("n"), F.count_if(cross).alias("c")).where("n > 1").select("series", F.round(F.col("c") / (F.col("n") - 1), 6).alias("zcr"))


@query(sql("samples", "select series, coalesce(min(i) filter (cross_ and abs(i - 20) = best), min(i) filter (abs(x) = quiet and best is null)) as at from (select *, min(case when cross_ then abs(i - 20) end) over (partition by series) as best, min(abs(x)) over (partition by series) as quiet from (select *, (x >= 0) <> (lag(x) over (partition by series order by i) >= 0) as cross_ from samples) where abs(i - 20) <= 8) group by series"))
def win_zero_cross(spark, sf):
    w = Window.partitionBy("series").orderBy("i")
    x = samples(spark, sf).withColumn("cross", (F.col("x") >= 0) != (F.lag("x").over(w) >= 0)).where("abs(i - 20) <= 8")
    near = F.min(F.when(F.col("cross"), F.struct(F.abs(F.col("i") - 20).alias("d"), "i"))).alias("near")
    return x.groupBy("series").agg(near, F.min(F.struct(F.abs("x").alias("a"), "i")).alias("quiet")).select("series", F.coalesce("near.i", "quiet.i").alias("at"))


@query(sql("frames", f"select series, count(*) filter ({LOUD}) as audible from frames group by series"))
def filt_silence(spark, sf):
    loud = F.log(F.col("f0") / 12345.6) >= F.log(F.lit(op.SILENCE))
    return frames(spark, sf).groupBy("series").agg(F.count_if(F.coalesce(loud, F.lit(False))).alias("audible"))


@query(sql("samples", "select series, coalesce(stddev_pop(x) filter (i % 7 = 0), 0) < 0.1 as flat from samples group by series"))
def filt_flat(spark, sf):
    return samples(spark, sf).groupBy("series").agg((F.coalesce(F.stddev_pop(F.when(F.col("i") % 7 == 0, F.col("x"))), F.lit(0.0)) < 0.1).alias("flat"))


@query(sql("frames", "select series, bool_and(abs(m) <= 1e-3 and (abs(s - 1) <= 1e-3 or s <= 1e-6)) and bool_or(abs(s - 1) <= 1e-3) as normalised from (select series, d, avg(v) as m, stddev_pop(v) as s from (select series, unnest([0, 1]) as d, unnest([case when series % 2 = 0 then (f0 - mf) / nullif(sf, 0) else f0 end, case when series % 2 = 0 then 0 else f1 end]) as v from (select *, avg(f0) over (partition by series) as mf, stddev_pop(f0) over (partition by series) as sf from frames)) where v is not null group by series, d) group by series"))
def filt_per_file_norm(spark, sf):
    w = Window.partitionBy("series")
    f = frames(spark, sf).withColumns({"mf": F.avg("f0").over(w), "sf": F.stddev_pop("f0").over(w)})
    even = F.col("series") % 2 == 0
    v0 = F.when(even, (F.col("f0") - F.col("mf")) / F.nullif(F.col("sf"), F.lit(0.0))).otherwise(F.col("f0"))
    v1 = F.when(even, 0.0).otherwise(F.col("f1"))
    g = f.select("series", v0.alias("a"), v1.alias("b")).groupBy("series").agg(*(x for c in "ab" for x in (F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"s{c}"))))
    near1 = lambda c: F.abs(F.col(f"s{c}") - 1) <= 1e-3
    fine = lambda c: (F.abs(f"m{c}") <= 1e-3) & (near1(c) | (F.col(f"s{c}") <= 1e-6))
    have = F.col("ma").isNotNull()
    both = (F.coalesce(fine("a"), F.lit(True)) | ~have) & fine("b") & (F.coalesce(near1("a"), F.lit(False)) | near1("b"))
    return g.select("series", both.alias("normalised"))


@query(sql("samples", "select series, m, round(a.x + (b.x - a.x) * (m * 1.5 - floor(m * 1.5)), 6) as x from (select series, unnest(range(0, floor((n - 1) / 1.5)::bigint + 1)) as m from sizes) t join samples a using (series) join samples b using (series) where a.i = floor(m * 1.5) and b.i = least(floor(m * 1.5) + 1, (select n - 1 from sizes s where s.series = t.series))", SIZES))
def fn_resample_linear(spark, sf):
    x = samples(spark, sf)
    size = x.groupBy("series").agg(F.count("*").alias("n"))
    t = size.select("series", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1.5))).alias("m")).withColumn("p", F.col("m") * 1.5)
    at = lambda name, i: x.select("series", F.col("i").alias(f"i_{name}"), F.col("x").alias(f"x_{name}")).withColumnRenamed(f"i_{name}", i)
    t = t.withColumns({"ia": F.floor("p"), "ib": F.least(F.floor("p") + 1, F.col("n") - 1)})
    t = t.join(at("a", "ia"), ["series", "ia"]).join(at("b", "ib"), ["series", "ib"])
    return t.select("series", "m", F.round(F.col("x_a") + (F.col("x_b") - F.col("x_a")) * (F.col("p") - F.floor("p")), 6).alias("x"))


@query(sql("samples", "select series, round(pow(10, -1 / 20.0) / max(abs(x)), 6) as gain, round(20 * log10(pow(10, -1 / 20.0) / max(abs(x))), 6) as db from samples group by series having max(abs(x)) > 0"))
def fn_peak_normalize(spark, sf):
    g = F.pow(F.lit(10.0), F.lit(-1 / 20.0)) / F.col("top")
    return samples(spark, sf).groupBy("series").agg(F.max(F.abs("x")).alias("top")).where("top > 0").select("series", F.round(g, 6).alias("gain"), F.round(20 * F.log10(g), 6).alias("db"))


@query("select event_id as id, least(255, floor(sqrt(a) * 255 + 0.5))::bigint as q, round(pow(least(255, floor(sqrt(a) * 255 + 0.5)) / 255.0, 2), 6) as amp from (select event_id, least(value / 100, 1) as a from events)")
def fn_compand(spark, sf):
    q = F.least(F.lit(255), F.floor(F.sqrt(F.least(F.col("value") / 100, F.lit(1.0))) * 255 + 0.5))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), q.alias("q"), F.round(F.pow(q / 255.0, 2), 6).alias("amp"))


@query("select event_id as id, round(pow(10, (value % 40) / 20), 6) as gain, round(20 * log10(value + 1), 6) as db, round(pow(2, (value % 12) / 12), 6) as rate from events")
def fn_db(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(F.pow(F.lit(10.0), (v % 40) / 20), 6).alias("gain"), F.round(20 * F.log10(v + 1), 6).alias("db"), F.round(F.pow(F.lit(2.0), (v % 12) / 12), 6).alias("rate"))
