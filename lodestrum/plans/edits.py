"""Queries of edit arithmetic and of formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrum.operators import edits as op
from lodestrum.plans.registry import query
from lodestrum.sources.tables import samples, sql, table

E = "e as (select event_id as id, value / 10 as d, (event_id % 17) / 8.0::double - 0.2 as a, value / 10 - (event_id % 13) / 9.0::double as b, (event_id % 7) / 3.0::double as c, value / 20 as f from events)"


def sql_clamp(x, lo, hi):
    return f"case when {x} < {lo} then {lo} when {x} > {hi} then {hi} else {x} end"


EDIT = f"""e1 as (select *, least(0.005, d) as m from e), e2 as (select *, {sql_clamp('a', '0', '(d - m)')} as cs from e1), e3 as (select *, {sql_clamp('b', '(cs + m)', 'd')} as ce from e2),
e4 as (select *, {sql_clamp('c', 'cs', 'ce')} as fi from e3), e5 as (select *, {sql_clamp('f', 'fi', 'ce')} as fo from e4)"""


def _edits(spark, sf):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(i.alias("id"), (v / 10).alias("d"), ((i % 17) / F.lit(8.0) - 0.2).alias("a"), (v / 10 - (i % 13) / F.lit(9.0)).alias("b"), ((i % 7) / F.lit(3.0)).alias("c"), (v / 20).alias("f"))


def _normal(spark, sf):
    return _edits(spark, sf).withColumns(op.normalize(*(F.col(c) for c in "dabcf")))


@query(f"with {E}, {EDIT} select id, round(cs, 6) as crop_start, round(ce, 6) as crop_end, round(fi, 6) as fade_in_end, round(fo, 6) as fade_out_start from e5")
def fn_normalize_edit(spark, sf):
    return _normal(spark, sf).select("id", *(F.round(c, 6).alias(c) for c in ("crop_start", "crop_end", "fade_in_end", "fade_out_start")))


def sql_normal(source: str, name: str) -> str:
    """The chain that puts handles a, b, c, f of a region d in order, as EDIT does, over any source."""
    steps = [f"{name}1 as (select *, least(0.005, d) as m from {source})", f"{name}2 as (select *, {sql_clamp('a', '0', '(d - m)')} as cs from {name}1)", f"{name}3 as (select *, {sql_clamp('b', '(cs + m)', 'd')} as ce from {name}2)"]
    steps += [f"{name}4 as (select *, {sql_clamp('c', 'cs', 'ce')} as fi from {name}3)", f"{name} as (select *, {sql_clamp('f', 'fi', 'ce')} as fo from {name}4)"]
    return ", ".join(steps)


SHOWN = "round(d, 6) as duration, round(cs, 6) as crop_start, round(fi, 6) as fade_in_end, round(fo, 6) as fade_out_start, round(ce, 6) as crop_end"


def _edit(spark, sf):
    """A normal edit of each event; the odd ones are reversed."""
    n = _normal(spark, sf).withColumns({"duration": F.greatest(F.lit(0.0), "d"), "reverse": F.col("id") % 2 == 1})
    return n, {c: F.col(c) for c in (*op.HANDLES, "duration", "reverse")}


def _shown(rows, e, *more):
    return rows.select("id", *(F.round(e[c], 6).alias(c) for c in ("duration", "crop_start", "fade_in_end", "fade_out_start", "crop_end")), *more)


@query(f"with {E}, {EDIT}, l0 as (select id, d, cs + s as a, ce as b, fi + s as c, fo as f from (select *, {sql_clamp('0.3', '-cs', '(fo - fi)')} as s from e5)), {sql_normal('l0', 'l')} select id, {SHOWN} from l")
def fn_link_edit(spark, sf):
    rows, e = _edit(spark, sf)
    return _shown(rows, op.link(e, "in", F.lit(0.3)))


REVERSED = f"r0 as (select id, d, d - ce as a, d - cs as b, d - ce + fi - cs as c, d - cs - (ce - fo) as f from e5), {sql_normal('r0', 'r')}"


@query(f"with {E}, {EDIT}, {REVERSED} select id, {SHOWN}, id % 2 = 0 as reverse from r")
def fn_reverse_edit(spark, sf):
    rows, e = _edit(spark, sf)
    out = op.reverse(e)
    return _shown(rows, out, out["reverse"].alias("reverse"))


KEPT = "k0 as (select *, case when id % 2 = 1 then d - ce else cs end as lo, case when id % 2 = 1 then d - cs else ce end as hi from e5)"


@query(f"with {E}, {EDIT}, {KEPT}, t0 as (select id, 10 + lo as s, 10 + hi as e, hi - lo as d, 0.0::double as a, hi - lo as b, fi - cs as c, hi - lo - (ce - fo) as f from (select * exclude (a, b, c, f, m) from k0)), {sql_normal('t0', 't')} select id, round(s, 6) as region_start, round(e, 6) as region_end, {SHOWN} from t")
def fn_trim_edit(spark, sf):
    rows, e = _edit(spark, sf)
    start, end, out = op.trim(e, F.lit(10.0))
    return _shown(rows, out, F.round(start, 6).alias("region_start"), F.round(end, 6).alias("region_end"))


REBASED = f"""b0 as (select *, {sql_clamp('(10.0::double + lo - 10.4::double)', '0', 'nd')} as u0, {sql_clamp('(10.0::double + hi - 10.4::double)', '0', 'nd')} as u1 from (select *, greatest(0, 9.5::double + d - 10.4::double) as nd from k0)),
b1 as (select *, u1 - u0 < least(0.005, nd) as none from b0), b2 as (select *, case when none then 0 else u0 end as v0, case when none then nd else u1 end as v1 from b1),
b3 as (select *, case when id % 2 = 1 then nd - v1 else v0 end as x, case when id % 2 = 1 then nd - v0 else v1 end as y from b2),
b4 as (select id, nd as d, x as a, y as b, x + fi - cs as c, y - (ce - fo) as f from (select * exclude (a, b, c, f, d, m) from b3)), {sql_normal('b4', 'bb')}"""


@query(f"with {E}, {EDIT}, {KEPT}, {REBASED} select id, {SHOWN} from bb")
def fn_rebase_edit(spark, sf):
    """Of a region from 10 to 10 + d to one from 10.4 to 9.5 + d."""
    rows, e = _edit(spark, sf)
    return _shown(rows, op.rebase(e, F.lit(10.0), F.lit(10.4), F.lit(9.5) + e["duration"]))


@query(f"with {E}, {EDIT}, v as (select *, k, d * k / 6.0::double as t from e5, (select unnest(range(0, 7)) as k)) select id, k, round(case when t < cs or t > ce then 0 else least(case when fi > cs and t < fi then (t - cs) / (fi - cs) else 1 end, case when ce > fo and t > fo then (ce - t) / (ce - fo) else 1 end) end, 7) as gain from v")
def fn_envelope(spark, sf):
    """Both fades of each edit at seven times of its region."""
    rows, e = _edit(spark, sf)
    d = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")))).withColumn("t", F.col("duration") * F.col("k") / 6)
    return d.select("id", "k", F.round(op.envelope(e, F.col("t")), 7).alias("gain"))


@query(f"with {E}, {EDIT} select id, round(cs + s, 6) as crop_start, round(ce + s, 6) as crop_end from (select *, {sql_clamp('0.25', '-cs', '(d - ce)')} as s from e5)")
def fn_slip_edit(spark, sf):
    rows, e = _edit(spark, sf)
    out = op.slip(e, F.lit(0.25))
    return rows.select("id", F.round(out["crop_start"], 6).alias("crop_start"), F.round(out["crop_end"], 6).alias("crop_end"))


T = "(event_id % 101) / 100.0::double"


def sql_fade(t, shape, k):
    if shape == "scurve":
        a = 2 * 4.0**k
        body = f"pow({t}, {a!r}) / (pow({t}, {a!r}) + pow(1 - {t}, {a!r}))"
    else:
        w = f"pow({t}, {10.0 ** k!r})" if k else t
        body = f"sin({w} * pi() / 2)" if shape == "equal" else w
    return f"case when not {t} > 0 then 0 when {t} >= 1 then 1 else {body} end"


@query(f"select event_id as id, round({sql_fade(T, 'power', 0.3)}, 6) as power, round({sql_fade(T, 'scurve', -0.4)}, 6) as scurve, round({sql_fade(T, 'equal', 0)}, 6) as equal_power from events")
def fn_fade(spark, sf):
    t = (F.col("event_id") % 101) / F.lit(100.0)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(op.fade_gain(t, "power", 0.3), 6).alias("power"), F.round(op.fade_gain(t, "scurve", -0.4), 6).alias("scurve"), F.round(op.fade_gain(t, "equal", 0.0), 6).alias("equal_power"))


@query("select distinct user_id as id, round(log10(ln(g) / ln(0.5)), 5) as tension from (select user_id, 0.02 + (user_id % 83) / 100.0::double as g from events)")
def fn_tension_inverse(spark, sf):
    g = 0.02 + (F.col("user_id") % 83) / F.lit(100.0)
    return table(spark, sf, "events").select("user_id").distinct().select(F.col("user_id").alias("id"), F.round(op.bisect(g), 5).alias("tension"))


@query(sql("samples", "select series, n - 1 - i as i, round(x * 0.5 * case when i < 4 then i / 4.0::double else 1 end, 8) as y from samples join sizes using (series) where i >= 2 and i < n", "sizes as (select series, count(*) as n from samples group by series)"))
def fn_render(spark, sf):
    """Crop two samples, fade in to the fourth, halve, reverse."""
    x = samples(spark, sf)
    n = x.groupBy("series").agg(F.count("*").alias("n"))
    gain = op.fade_gain(F.col("i") / F.lit(4.0), "power", 0.0) * 0.5
    return x.where("i >= 2").join(n, "series").select("series", (F.col("n") - 1 - F.col("i")).alias("i"), F.round(F.col("x") * gain, 8).alias("y"))


@query("select event_id as id, case when s < 0.1 then greatest(1, floor(s * 1000 + 0.5))::bigint::varchar || ' ms' when s < 60 then floor(s + 0.5)::bigint::varchar || ' s' when t >= 3600 then (t // 3600)::varchar || ':' || lpad((t % 3600 // 60)::varchar, 2, '0') || ':' || lpad((t % 60)::varchar, 2, '0') else (t // 60)::varchar || ':' || lpad((t % 60)::varchar, 2, '0') end as shown from (select *, floor(s + 0.5)::bigint as t from (select event_id, case event_id % 3 when 0 then value / 10000 when 1 then 10 + value / 12 else value * 31 + 60 end as s from events))")
def fn_format_duration(spark, sf):
    k, v = F.col("event_id") % 3, F.col("value")
    d = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(k == 0, v / 10000).when(k == 1, 10 + v / 12).otherwise(v * 31 + 60).alias("s"))
    s, t = F.col("s"), F.floor(F.col("s") + 0.5)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda x: F.floor(x).cast("string")
    shown = F.when(s < 0.1, F.concat(F.greatest(F.lit(1), F.floor(s * 1000 + 0.5)).cast("string"), F.lit(" ms"))).when(s < 60, F.concat(t.cast("string"), F.lit(" s")))
    shown = shown.when(t >= 3600, F.concat_ws(":", whole(t / 3600), two(F.floor(t % 3600 / 60)), two(t % 60))).otherwise(F.concat_ws(":", whole(t / 60), two(t % 60)))
    return d.select("id", shown.alias("shown"))


@query("select doc_id as id, case when n < 1024 then n::varchar || ' B' when n < 1048576 then floor(n / 1024.0::double + 0.5)::bigint::varchar || ' KB' else floor(n / 1048576.0::double + 0.5)::bigint::varchar || ' MB' end as shown from (select doc_id, n_chars * (1 + (doc_id % 5) * 700) as n from documents)")
def fn_format_bytes(spark, sf):
    n = F.col("n")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") * (1 + F.col("doc_id") % 5 * 700)).alias("n"))
    part = lambda size, unit: F.concat(F.floor(n / F.lit(float(size)) + 0.5).cast("string"), F.lit(unit))
    return d.select("id", F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, part(1024, " KB")).otherwise(part(1048576, " MB")).alias("shown"))


@query("select distinct user_id as id, array_to_string(list_filter([(case when r % 1000 = 0 then (r // 1000)::varchar else (r // 1000)::varchar || '.' || (r % 1000 // 100)::varchar end) || ' kHz', case when b = 0 then '' when f = 3 then b::varchar || '-bit float' else b::varchar || '-bit' end, case c when 1 then 'Mono' when 2 then 'Stereo' when 0 then '' else c::varchar || ' ch' end], lambda x: x <> ''), ' · ') as shown from (select user_id, [44100, 48000, 96000, 22500][user_id % 4 + 1] as r, [0, 16, 24, 32][user_id % 3 + 1] as b, user_id % 4 as f, user_id % 5 as c from events)")
def fn_format_format(spark, sf):
    u = F.col("user_id")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (u % k + 1).cast("int"))
    d = table(spark, sf, "events").select("user_id").distinct().select(u.alias("id"), pick((44100, 48000, 96000, 22500), 4).alias("r"), pick((0, 16, 24, 32), 3).alias("b"), (u % 4).alias("f"), (u % 5).alias("c"))
    text = lambda c: c.cast("string")
    r, b, c = F.col("r"), F.col("b"), F.col("c")
    khz = F.concat(F.when(r % 1000 == 0, text(F.floor(r / 1000))).otherwise(F.concat(text(F.floor(r / 1000)), F.lit("."), text(F.floor(r % 1000 / 100)))), F.lit(" kHz"))
    bits = F.when(b == 0, "").when(F.col("f") == 3, F.concat(text(b), F.lit("-bit float"))).otherwise(F.concat(text(b), F.lit("-bit")))
    ch = F.when(c == 1, "Mono").when(c == 2, "Stereo").when(c == 0, "").otherwise(F.concat(text(c), F.lit(" ch")))
    return d.select("id", F.array_join(F.filter(F.array(khz, bits, ch), lambda x: x != ""), " · ").alias("shown"))


ERRORS = "case doc_id % 5 when 0 then 'x: Invalid data found when processing input' when 1 then 'Not yet implemented in FFmpeg' when 2 then 'ENOENT: no such file' when 3 then 'EBUSY: locked' else 'other' end"


@query(f"select doc_id as id, case when regexp_matches(lower(e), 'invalid data found when processing input|does not contain any stream|error opening output file') then 'unreadable' when regexp_matches(lower(e), 'not yet implemented in ffmpeg') then 'variant' when e like '%ENOENT%' then 'missing' when regexp_matches(e, 'EBUSY|EPERM|EACCES') then 'locked' else e end as reason from (select doc_id, {ERRORS} as e from documents)")
def fn_plain_error(spark, sf):
    e = F.col("e")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr(ERRORS).alias("e"))
    return d.select("id", F.when(e.rlike("(?i)invalid data found when processing input|does not contain any stream|error opening output file"), "unreadable").when(e.rlike("(?i)not yet implemented in ffmpeg"), "variant").when(e.contains("ENOENT"), "missing").when(e.rlike("EBUSY|EPERM|EACCES"), "locked").otherwise(e).alias("reason"))


@query("select item_id as id, list_filter(list_transform(string_split_regex(text, '[,\n;]'), lambda x: substr(trim(regexp_replace(x, ' +', ' ', 'g')), 1, 60)), lambda x: x <> '') as words from benchmark")
def fn_split_words(spark, sf):
    parts = F.transform(F.split("text", "[,\n;]"), lambda x: F.substring(F.trim(F.regexp_replace(x, " +", " ")), 1, 60))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.filter(parts, lambda x: x != "").alias("words"))


@query("select distinct user_id as id, list_concat([e], list_transform(range(0, 12), lambda d: t), [e], list_transform(range(0, 12), lambda d: r), [e * 0.7], list_transform(range(0, 12), lambda d: r * 0.7), [b, x, b, e, r]) as weights from (select user_id, 1.0::double + user_id % 3 as t, 0.5::double * (user_id % 5) as b, 0.25::double * (user_id % 7) as x, 0.5::double + user_id % 2 as e, 0.8::double * (user_id % 4) as r from events)")
def fn_axis_weights(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    k = lambda n: F.col("user_id") % n
    w = op.axis_weights(timbre=1.0 + k(3), brightness=0.5 * k(5), texture=0.25 * k(7), energy=0.5 + k(2), transient=0.8 * k(4))
    return u.select(F.col("user_id").alias("id"), w.alias("weights"))


def sql_number(x: str) -> str:
    fixed = f"regexp_replace(format('{{:.6f}}', floor({x} * 1e6 + 0.5) / 1e6), '\\.?0+$', '')"
    return f"case when {fixed} = '-0' then '0' else {fixed} end"


NUMBERS = {"duration": "d", "crop_start": "cs", "crop_end": "ce", "fade_in_end": "fi", "fade_out_start": "fo", "fade_in_tension": "((id % 9) / 4.0::double - 1)", "fade_out_tension": "(-(id % 5) / 7.0::double)", "gain_db": "((id % 31) * 0.1::double - 1.2)", "semitones": "((id % 25) - 12::double)"}
SHAPES = ("power", "scurve", "equal")


def _sql_part(name: str) -> str:
    if name == "reverse":
        return "case when id % 2 = 1 then '1' else '0' end"
    if name.endswith("shape"):
        return f"'\"' || (['power', 'scurve', 'equal'])[(id + {len(name)}) % 3 + 1] || '\"'"
    return sql_number(NUMBERS[name])


SIGNED = f"signed as (select id, '[{op.DSP_VERSION},' || " + " || ',' || ".join(_sql_part(n) for n in op.PARAMETERS) + " || ']' as signature from e5)"


def _signed(spark, sf):
    n, i = _normal(spark, sf), F.col("id")
    shape = lambda name: F.element_at(F.array(*map(F.lit, SHAPES)), ((i + len(name)) % 3 + 1).cast("int"))
    e = {c: F.col(c) for c in ("crop_start", "crop_end", "fade_in_end", "fade_out_start")} | {"duration": F.col("d"), "reverse": i % 2 == 1}
    e |= {"fade_in_tension": (i % 9) / F.lit(4.0) - 1, "fade_out_tension": -(i % 5) / F.lit(7.0), "gain_db": (i % 31) * F.lit(0.1) - 1.2, "semitones": (i % 25) - F.lit(12.0)}
    e |= {name: shape(name) for name in ("fade_in_shape", "fade_out_shape")}
    return n.select("id", op.signature(e).alias("signature"))


@query(f"with {E}, {EDIT}, {SIGNED} select id, signature from signed")
def fn_edit_signature(spark, sf):
    return _signed(spark, sf)


def sql_lane(text: str, start: int, prime: int) -> str:
    return f"lpad(to_hex(list_reduce(list_prepend({start}::bigint, list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::bigint)), lambda h, c: (xor(h, c) * {prime}) & 4294967295)), 8, '0')"


@query(f"with {E}, {EDIT}, {SIGNED} select id, lower({' || '.join(sql_lane('signature', *x) for x in op.LANES)}) as key from signed")
def fn_fnv_key(spark, sf):
    """The key of an edit: two lanes over its signature."""
    return _signed(spark, sf).select("id", op.hash_key(F.col("signature")).alias("key"))


RGB = "rgb as (select p_partkey as id, (p_partkey % 256) / 255.0::double as r, (p_size * 5 % 256) / 255.0::double as g, (p_partkey * 7 % 256) / 255.0::double as b from part)"
LINEAR = "case when {0} <= 0.04045 then {0} / 12.92 else pow(({0} + 0.055) / 1.055, 2.4) end"


def _rgb(spark, sf):
    c, k = (lambda x: (x % 256) / F.lit(255.0)), F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), c(k).alias("r"), c(F.col("p_size") * 5).alias("g"), c(k * 7).alias("b"))


HSL = """select id, round(case when s = 0 then 0 when hi = r then 60 * (((g - b) / s) - 6 * floor(((g - b) / s) / 6)) when hi = g then 60 * ((b - r) / s + 2) else 60 * ((r - g) / s + 4) end, 6) as hue,
 round(case when s = 0 then 0 else s / (1 - abs(hi + lo - 1)) end, 6) as saturation, round((hi + lo) / 2, 6) as light from (select *, hi - lo as s from (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from rgb))"""


@query(f"with {RGB} {HSL}")
def fn_hsl(spark, sf):
    h, s, light = op.hsl(*(F.col(c) for c in "rgb"))
    return _rgb(spark, sf).select("id", F.round(h, 6).alias("hue"), F.round(s, 6).alias("saturation"), F.round(light, 6).alias("light"))


def _sum(ws, xs):
    return " + ".join(f"({w!r}) * {x}" for w, x in zip(ws, xs, strict=True))


OKLAB = f"lin as (select id, {', '.join(LINEAR.format(c) + f' as l{c}' for c in 'rgb')} from rgb), cone as (select id, {', '.join(f'cbrt({_sum(ws, ("lr", "lg", "lb"))}) as c{k}' for k, ws in enumerate(op.CONES))} from lin)"


@query(f"with {RGB}, {OKLAB} select id, {', '.join(f'round({_sum(ws, ("c0", "c1", "c2"))}, 6) as {n}' for n, ws in zip(('light', 'a', 'b'), op.COORDINATES, strict=True))} from cone")
def fn_oklab(spark, sf):
    light, a, b = op.oklab(*(F.col(c) for c in "rgb"))
    return _rgb(spark, sf).select("id", F.round(light, 6).alias("light"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query(f"with {RGB}, {OKLAB} select id, round((greatest(y, 0.2) + 0.05) / (least(y, 0.2) + 0.05), 6) as contrast from (select id, 0.2126 * lr + 0.7152 * lg + 0.0722 * lb as y from lin)")
def fn_contrast(spark, sf):
    return _rgb(spark, sf).select("id", F.round(op.contrast(op.luminance(*(F.col(c) for c in "rgb")), F.lit(0.2)), 6).alias("contrast"))
