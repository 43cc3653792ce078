"""Queries of fingerprint search: coarse candidates, calibration, collapsing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.operators import series as op
from lodestrum.plans.registry import query
from lodestrum.plans.series import STATS, SUMS, summaries
from lodestrum.sources.tables import frames, sql, table

#: Candidates of each coarse list for a query under 2.5 s, as in the reference.
CANDIDATES = 250

def _z(values: str) -> str:
    """A raw frame in standard units at length one, as SQL over an expression for each dimension."""
    v = "[" + ", ".join(f"({values.format(d=d)} - m{d}) / t{d}" for d in range(op.DIMS)) + "]"
    return f"list_transform({v}, lambda x: case when list_dot_product({v}, {v}) > 0 then x / sqrt(list_dot_product({v}, {v})) else 0 end)"


COARSE = f"""vecs as (select series, case when counted > 0 then {_z("s{d} / nullif(counted, 0)")} else [0.0, 0.0, 0.0, 0.0]::double[] end as mean, {_z("attack[{d} + 1]")} as attack from sums, stats),
q as (select mean as qm, attack as qa from vecs where series = (select min(series) from vecs)),
sc as (select series, list_dot_product(mean, qm) as sm, list_dot_product(attack, qa) as sa from vecs, q)"""
TOPS = f"tm as (select series from sc order by round(sm, 9) desc, series limit {CANDIDATES}),\nta as (select series from sc order by round(sa, 9) desc, series limit {CANDIDATES})"


def coarse(f):
    """Each series' likeness to the first one, by mean frame and by loudest frame, and the statistics over all."""
    sums, stats = summaries(f)
    s = op.coarse_vectors(sums, stats)
    q = s.orderBy("series").limit(1).select(F.col("mean").alias("qm"), F.col("attack").alias("qa"))
    return s.join(F.broadcast(q)).select("series", op.dot_fixed(F.col("mean"), F.col("qm")).alias("sm"), op.dot_fixed(F.col("attack"), F.col("qa")).alias("sa")), stats


def candidates(s):
    top = lambda c: s.orderBy(F.desc(F.round(c, 9)), "series").limit(CANDIDATES).select("series")
    return top("sm").union(top("sa")).distinct()


@query(sql("frames", "select series, round(sm, 6) as sm, round(sa, 6) as sa from sc where series in (select series from tm union select series from ta)", SUMS, STATS, COARSE, TOPS))
def q_echo_coarse(spark, sf):
    s, _ = coarse(frames(spark, sf))
    return s.join(candidates(s), "series", "left_semi").select("series", F.round("sm", 6).alias("sm"), F.round("sa", 6).alias("sa"))


@query(sql("frames", "select series from tm union select series from ta", SUMS, STATS, COARSE, TOPS))
def set_union_cands(spark, sf):
    return candidates(coarse(frames(spark, sf))[0])


def sql_tau(ms: str) -> str:
    parts = [f"when {ms} <= {op.TAU[0][0]} then {op.TAU[0][1]}"]
    parts += [f"when {ms} <= {m1} then {t0} + ({t1} - {t0}) * (ln({ms}) - ln({m0})) / (ln({m1}) - ln({m0}))" for (m0, t0), (m1, t1) in zip(op.TAU, op.TAU[1:], strict=False)]
    return f"(case {' '.join(parts)} else {op.TAU[-1][1]} end)::double"


@query(f"select event_id as id, round({sql_tau('ms')}, 6) as tau, round(greatest(0, least(1, (0.93 - {sql_tau('ms')}) / (1 - {sql_tau('ms')}))), 6) as confidence from (select event_id, value * 100 + 1 as ms from events)")
def fn_confidence(spark, sf):
    ms = F.col("value") * 100 + 1
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(op.tau(ms), 6).alias("tau"), F.round(op.confidence(F.lit(0.93), ms), 6).alias("confidence"))


@query("select event_id as id, round(greatest(0, least(1, ((value % 1) - 0.80) / 0.20)), 6) as confidence from events")
def fn_file_confidence(spark, sf):
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") % 1 - 0.80) / 0.20))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(c, 6).alias("confidence"))


@query("select event_id as id, case when s is null then 0 when s >= 0.555 then 4 when s >= 0.455 then 3 when s >= 0.365 then 2 else 1 end::bigint as bars from (select event_id, case when event_id % 9 = 0 then null else value % 1 end as s from events)")
def fn_bars(spark, sf):
    s = F.when(F.col("event_id") % 9 != 0, F.col("value") % 1)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(s.isNull(), 0).when(s >= 0.555, 4).when(s >= 0.455, 3).when(s >= 0.365, 2).otherwise(1).cast("long").alias("bars"))


@query("select event_id as id, list_transform(case when d <= 10.5 then [0.0::double] when d <= 30 then list_transform(range(0, 3), lambda k: (d - 10) * k / 2) else list_transform(range(0, 5), lambda k: (d - 10) * k / 4) end, lambda x: round(x, 6)) as starts from (select event_id, value as d from events)")
def fn_clap_offsets(spark, sf):
    d = F.col("value")
    some = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.round((d - 10) * k / (n - 1), 6))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(d <= 10.5, F.array(F.lit(0.0))).when(d <= 30, some(3)).otherwise(some(5)).alias("starts"))


PRINTS = """files as (select user_id as path, max(event_id) as mtime, max(value) * 1000 as duration_ms from events group by user_id),
prints as (select user_id as path, max(event_id) + (user_id % 5 = 0)::int as mtime, 2 - (user_id % 7 = 0)::int as version, min(value) * 20000 as span_ms from events where user_id % 4 <> 0 group by user_id)"""


@query(f"with {PRINTS} select f.path, coalesce(p.mtime is null or p.mtime <> f.mtime or p.version <> {op.VERSION} or least(f.duration_ms, {op.SPAN_MS}) - p.span_ms > {op.SHORT_MS}, true) as needs from files f left join prints p using (path)")
def cdc_echo_needs(spark, sf):
    """Files whose fingerprint is missing, older, of another version or of too short a span."""
    ev = table(spark, sf, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("mtime"), (F.max("value") * 1000).alias("duration_ms"), (F.min("value") * 20000).alias("span_ms"))
    prints = ev.where("path % 4 <> 0").select("path", (F.col("mtime") + (F.col("path") % 5 == 0).cast("int")).alias("mtime"), (2 - (F.col("path") % 7 == 0).cast("int")).alias("version"), "span_ms")
    return op.needs_fingerprint(ev.select("path", "mtime", "duration_ms"), prints)


@query("select user_id as id, abs(n - old) >= case when old >= 20 then greatest(20, floor(old * 0.01 + 0.5)) else 1 end as again from (select user_id, count(*) * 3 as n, min(event_id) % 60 as old from events group by user_id)")
def cdc_resnapshot(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg((F.count("*") * 3).alias("n"), (F.min("event_id") % 60).alias("old"))
    need = F.when(F.col("old") >= 20, F.greatest(F.lit(20), F.floor(F.col("old") * 0.01 + 0.5))).otherwise(1)
    return u.select(F.col("user_id").alias("id"), (F.abs(F.col("n") - F.col("old")) >= need).alias("again"))


PALETTE = """pal as (select p_brand as brief, p_partkey as image, unnest([0, 1, 2]) as k, unnest([upper(split_part(p_name, ' ', 1)), split_part(p_name, ' ', 2), lower(p_type)]) as colour from part),
once as (select brief, lower(colour) as c, min((k, image, colour)) as first from pal group by all)"""


@query(f"with {PALETTE} select brief, row_number() over (partition by brief order by first) as place, first[3] as colour from once qualify place <= 6")
def agg_palette_rr(spark, sf):
    """Six colours of each brief: the first of each image, then the second, each colour once whatever its letters' case."""
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    colours = p.select(F.col("p_brand").alias("brief"), F.col("p_partkey").alias("image"), F.posexplode(F.array(F.upper(words[0]), words[1], F.lower("p_type"))).alias("k", "colour"))
    return op.round_robin(colours, 6)
