"""Queries over vectors: neighbours, suggestions, centroids, concepts and briefs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.functions.vector import blend, dot, rounded, unit
from lodestrum.operators import concepts
from lodestrum.operators import similar as op
from lodestrum.operators.vector_index import StoredLists
from lodestrum.plans.registry import query
from lodestrum.session import shared, ship
from lodestrum.sources.tables import entries, sql, table, vectors

CENT = """dims as (select label, d, avg(x) as m from (select label, unnest(range(1, 65)) as d, unnest(vec) as x from vectors) group by label, d),
means as (select label, list(m order by d) as mean from dims group by label),
cents as (select label, list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) as cvec from means)"""


@query(sql("vectors", "select label, list_transform(cvec, lambda x: round(x, 6)) as vec from cents", CENT))
def agg_centroid(spark, sf):
    return op.centroid(vectors(spark, sf), "label").select("label", rounded(F.col("vec")).alias("vec"))


@query(sql("vectors", """select label, round(list_dot_product(a, a), 6) as length, round(a[1], 6) as first from (
 select label, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) as a from (select label, list(t order by d) as s from (
   select label, d, sum(x) as t from (select label, unnest(range(1, 65)) as d, unnest(vec) as x from vectors) group by label, d) group by label))"""))
def agg_meanpool(spark, sf):
    c = op.centroid(vectors(spark, sf).withColumn("vec", unit(F.col("vec"))), "label")
    return c.select("label", F.round(dot(F.col("vec"), F.col("vec")), 6).alias("length"), F.round(F.col("vec")[0], 6).alias("first"))


@query(sql("vectors", "select a.id as qid, b.id, round(list_dot_product(a.vec, b.vec), 6) as score, row_number() over (partition by a.id order by list_dot_product(a.vec, b.vec) desc, b.id) as rank from vectors a join vectors b on a.id <> b.id qualify rank <= 10"))
def q_knn_all_pairs(spark, sf):
    ship(spark)
    v = vectors(spark, sf)
    return op.knn(v.select("id", "vec"), v, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def q_knn_approximate(spark, sf):
    ship(spark)
    v = vectors(spark, sf)
    return op.knn_approximate(v.where("id % 50 = 0"), v, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


query()(q_knn_approximate)


def q_knn_stored(spark, sf):
    """A stored index, a third of whose rows a second generation puts anew."""
    ship(spark)
    v = vectors(spark, sf)
    index = StoredLists.create(v, f"{shared(spark)}/lists-{uuid4().hex}")
    index.put(v.where("label % 3 = 0"))
    return index.search(v.where("id % 50 = 0"), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


query()(q_knn_stored)


@query(sql("vectors entries", """select id, round(score, 6) as score, round(greatest(0, least(1, (score - 0.80) / 0.20)), 6) as confidence, score < 0.85 as weak, score >= 0.9995 as identical
from (select b.id, list_dot_product(a.vec, b.vec) as score from vectors a join vectors b on a.id = 3 and b.id <> 3) order by identical desc, score desc, id limit 30"""))
def q_knn_file(spark, sf):
    v = vectors(spark, sf)
    q = v.where("id = 3").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    s = v.join(F.broadcast(q)).where("id <> qid").select("id", dot(F.col("vec"), F.col("qvec")).alias("score"))
    s = s.withColumns({"identical": F.col("score") >= 0.9995, "weak": F.col("score") < 0.85, "confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - 0.80) / 0.20)), 6)})
    return s.orderBy(F.desc("identical"), F.desc("score"), "id").limit(30).select("id", F.round("score", 6).alias("score"), "confidence", "weak", "identical")


def sql_suggest(k: int) -> str:
    return f"""members as (select id, vec, row_number() over (order by id) - 1 as i, count(*) over () as n from vectors where label = 2 and id % 3 = 0),
sample_ as (select id, vec from members where n <= 16 or list_contains(list_transform(range(0, 16), lambda k: (k * n) // 16), i)),
mid_ as (select list(m order by d) as mean from (select d, avg(x) as m from (select unnest(range(1, 65)) as d, unnest(vec) as x from members) group by d)),
cen_ as (select list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) as cvec from mid_),
asked_ as (select -1 as q, cvec as qv, 3 * {k} as most from cen_ union all select id, vec, {k} from sample_),
cand_ as (select distinct id from (select v.id, row_number() over (partition by q order by list_dot_product(v.vec, qv) desc, v.id) as r, most from vectors v, asked_) where r <= most + (select count(*) from members) and id not in (select id from members)),
best_ as (select v.id, any_value(v.vec) as vec, max(list_dot_product(v.vec, s.vec)) as best from vectors v join cand_ using (id), sample_ s group by v.id),
heard_ as (select id, vec, 0.7 * greatest(best, 0) + 0.3 * list_dot_product(vec, cvec) as score from best_, cen_ where id not in (select v.id from vectors v, members m where list_dot_product(v.vec, m.vec) > 0.9995)),
sug as (select id, score from heard_ h where not exists (select 1 from heard_ o where o.score > h.score and list_dot_product(o.vec, h.vec) > 0.9995) order by score desc, id limit {k})"""


@query(sql("vectors", "select id, round(score, 6) as score from sug", sql_suggest(24)))
def q_suggest(spark, sf):
    ship(spark)
    v = vectors(spark, sf)
    return op.suggest(v, v.where("label = 2 and id % 3 = 0"), 24).select("id", F.round("score", 6).alias("score"))


@query(sql("vectors", "select id, round(score, 6) as score from sug where id % 2 = 1 order by sug.score desc, id limit 16", sql_suggest(24)))
def q_more(spark, sf):
    """Of 24 suggestions for a collection the first 16 that the vault doesn't hold yet."""
    ship(spark)
    v = vectors(spark, sf)
    found = op.suggest(v, v.where("label = 2 and id % 3 = 0"), 24)
    held = v.where("id % 2 = 0").select("id")
    return found.join(held, "id", "left_anti").orderBy(F.desc("score"), "id").limit(16).select("id", F.round("score", 6).alias("score"))


@query(sql("vectors", "select a.id, b.id as other, round(list_dot_product(a.vec, b.vec), 6) as score from vectors a join vectors b on a.label = b.label and a.id < b.id where list_dot_product(a.vec, b.vec) > 0.45"))
def join_self_sim(spark, sf):
    ship(spark)
    rows = vectors(spark, sf).select("id", "vec", F.col("label").alias("list"))
    return op.similar_pairs(rows, 0.45).select("id", "other", F.round("score", 6).alias("score"))


@query(sql("vectors", "select id, label, round(list_dot_product(vec, qvec), 6) as score from vectors, (select vec as qvec from vectors where id = 1)"))
def join_broadcast(spark, sf):
    v = vectors(spark, sf)
    return v.join(F.broadcast(v.where("id = 1").select(F.col("vec").alias("qvec")))).select("id", "label", F.round(dot(F.col("vec"), F.col("qvec")), 6).alias("score"))


@query(sql("vectors", "select id, round(list_dot_product(vec, vec), 6) as dot, round(sqrt(list_dot_product(vec, vec)), 6) as norm from vectors"))
def fn_dot(spark, sf):
    v = F.col("vec")
    return vectors(spark, sf).select("id", F.round(dot(v, v), 6).alias("dot"), F.round(F.sqrt(dot(v, v)), 6).alias("norm"))


BLEND = "select id, list_transform(b, lambda x: round(x / sqrt(list_dot_product(b, b)), 6)) as vec from (select id, list_transform(list_zip(vec, qvec), lambda z: z[1] + {w} * z[2]) as b from vectors, (select vec as qvec from vectors where id = 0))"


def _blended(spark, sf, weight):
    v = vectors(spark, sf)
    q = v.where("id = 0").select(F.col("vec").alias("qvec"))
    return v.join(F.broadcast(q)).select("id", rounded(blend(F.col("vec"), F.col("qvec"), weight)).alias("vec"))


@query(sql("vectors", BLEND.format(w="0.5")))
def fn_query_blend(spark, sf):
    return _blended(spark, sf, 0.5)


@query(sql("vectors", BLEND.format(w="0.2")))
def fn_context_blend(spark, sf):
    return _blended(spark, sf, 0.2)


@query(sql("vectors", "select id, list_transform(vec, lambda x: case when m > 0 then floor(x / (m / 127) + 0.5)::bigint else 0 end) as q, round(m / 127, 9) as scale from (select id, vec, list_max(list_transform(vec, lambda x: abs(x))) as m from vectors)"))
def fn_int8_quant(spark, sf):
    v = vectors(spark, sf).withColumn("m", F.array_max(F.transform("vec", F.abs)))
    return v.select("id", F.transform("vec", lambda x: F.when(F.col("m") > 0, F.floor(x / (F.col("m") / 127) + 0.5)).otherwise(0).cast("long")).alias("q"), F.round(F.col("m") / 127, 9).alias("scale"))


ZS = """sims as (select v.id, c.label as concept, list_dot_product(v.vec, c.cvec) as s from vectors v, cents c),
zs as (select *, (s - avg(s) over (partition by id)) / stddev_pop(s) over (partition by id) as z from sims)"""


def _z(spark, sf):
    v = vectors(spark, sf)
    c = op.centroid(v, "label").select(F.col("label").alias("concept"), F.col("vec").alias("cvec"))
    s = v.join(F.broadcast(c)).select("id", "concept", dot(F.col("vec"), F.col("cvec")).alias("s"))  # a centroid for each label: ten
    w = Window.partitionBy("id")
    return s.withColumn("z", (F.col("s") - F.avg("s").over(w)) / F.stddev_pop("s").over(w))


@query(sql("vectors", "select id, concept, round(z, 6) as z from zs", CENT, ZS))
def agg_zscore(spark, sf):
    return _z(spark, sf).select("id", "concept", F.round("z", 6).alias("z"))


VOCABULARY = """part_ as (select p_partkey as term_id, split_part(p_name, ' ', 1) || p_partkey::varchar as term, p_partkey % 10 as concept from part)"""
CONCEPTS = f"""{VOCABULARY},
views as (select id, id // 2 as image, id % 2 as view, vec from vectors),
ts as (select image, view, term_id, list_dot_product(v.vec, t.vec) as s from views v, (select id as term_id, vec from vectors where id in (select term_id from part_)) t),
tz as (select image, term_id, max((s - m) / sqrt(greatest(1e-12, q - m * m))) as z from (select *, avg(s) over w as m, avg(s * s) over w as q from ts window w as (partition by image, view)) group by all),
cs as (select image, view, label as concept, list_dot_product(v.vec, cvec) as s from views v, cents),
cz as (select image, concept, max((s - m) / sqrt(greatest(1e-12, q - m * m))) as z from (select *, avg(s) over w as m, avg(s * s) over w as q from cs window w as (partition by image, view)) group by all),
best as (select t.image, p.term, t.z as tz, p.concept, c.z as cz from tz t join part_ p using (term_id) join cz c on c.image = t.image and c.concept = p.concept where t.z >= 4.0 and c.z >= 1.5),
told as (select image, concept, arg_max(term, (tz + 0.5 * cz, term)) as term, max(tz + 0.5 * cz) as evidence from best group by all)"""


def _scores(spark, sf):
    """Pictures of two views each, a vocabulary of words that each lead to one category, and the z-scores of both."""
    v = vectors(spark, sf)
    views = v.select((F.floor(F.col("id") / 2)).alias("image"), (F.col("id") % 2).alias("view"), "vec")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("term_id"), F.concat(F.split("p_name", " ")[0], F.col("p_partkey").cast("string")).alias("term"), (F.col("p_partkey") % 10).alias("concept"))
    words = v.join(p, F.col("id") == F.col("term_id")).select("term", F.col("vec").alias("qvec"))
    centres = op.centroid(v, "label").select(F.col("label").alias("concept"), F.col("vec").alias("qvec"))  # one for each label: ten
    likeness = views.join(F.broadcast(centres)).withColumn("s", dot(F.col("vec"), F.col("qvec"))).drop("vec", "qvec")
    return concepts.z_scores(likeness, "concept"), concepts.outstanding(views, words, "term", concepts.TERM_Z), p.select("term", "concept")


def _items(spark):
    cats = ["WATER", "ANIMALS", "WOOD", "VEHICLES", "DOORS", "METAL", "WEATHER", "FOOD", "DESIGNED", "GAMES"]
    return spark.createDataFrame([(k, f"{c[:4]}Misc", c.lower(), c, "MISC" if k % 2 else "BIRD" if k == 4 else "DROP") for k, c in enumerate(cats)], "concept long, key string, label string, cat string, sub string")


@query(sql("vectors", "select image, concept, term, round(evidence, 6) as evidence from told where concept not in (4, 8) union all select image, concept, null, round(1.5 * z, 6) from cz where z >= 3.2 and concept not in (4, 8) and (image, concept) not in (select (image, concept) from told)", CENT, CONCEPTS))
def q_concepts(spark, sf):
    """The best evidence of each category in each picture: a word that stands out where the picture supports its category, or
    the category alone. Two categories can't be seen."""
    ship(spark)
    c, t, terms = _scores(spark, sf)
    out = concepts.candidates(c, t, terms, _items(spark))
    return out.select("image", "concept", "term", F.round("evidence", 6).alias("evidence"))


def q_concept_chips(spark, sf):
    """What each picture shows: greedy, so without SQL."""
    ship(spark)
    c, t, terms = _scores(spark, sf)
    return concepts.chips(c, t, terms, _items(spark))


query()(q_concept_chips)


CANDIDATES = """cand as (select image, concept, term, evidence from told where concept not in (4, 8) union all select image, concept, null, 1.5 * z from cz where z >= 3.2 and concept not in (4, 8) and (image, concept) not in (select (image, concept) from told)),
items(concept, cat) as (values (0, 'WATER'), (1, 'ANIMALS'), (2, 'WOOD'), (3, 'VEHICLES'), (4, 'DOORS'), (5, 'METAL'), (6, 'WEATHER'), (7, 'FOOD'), (8, 'DESIGNED'), (9, 'GAMES'))"""


def _candidates(spark, sf):
    ship(spark)
    c, t, terms = _scores(spark, sf)
    return concepts.candidates(c, t, terms, _items(spark)).join(F.broadcast(_items(spark).select("concept", "cat")), "concept")  # a vocabulary of fixed size


@query(sql("vectors", "select cat, image, coalesce(arg_max(coalesce(term, ''), (evidence, -concept)), '') as term, round(max(evidence), 6) as evidence from cand join items using (concept) group by all", CENT, CONCEPTS, CANDIDATES))
def agg_best_evidence(spark, sf):
    """The word with the most evidence of each category in each picture."""
    best = F.max_by(F.coalesce("term", F.lit("")), F.struct("evidence", -F.col("concept")))
    return _candidates(spark, sf).groupBy("cat", "image").agg(best.alias("term"), F.round(F.max("evidence"), 6).alias("evidence"))


@query(sql("vectors", f"select image, concept, k from (select *, row_number() over (partition by image, cat order by evidence desc, concept) as k from cand join items using (concept)) where k <= case when cat in {tuple(concepts.MATERIALS)!r} then 1 else 2 end", CENT, CONCEPTS, CANDIDATES))
def win_per_cat_cap(spark, sf):
    """Of each picture and category the best two, of a material the best one; candidates of a picture are few."""
    w = Window.partitionBy("image", "cat").orderBy(F.desc("evidence"), "concept")
    most = F.when(F.col("cat").isin(concepts.MATERIALS), 1).otherwise(2)
    return _candidates(spark, sf).withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= most).select("image", "concept", "k")


@query(sql("vectors", "select id, concept, round(case when hi <= 0.1 then 1 else (s - 0.1) / (hi - 0.1) end, 6) as scaled from (select *, max(s) over (partition by concept) as hi from sims) where s >= 0.1", CENT, ZS.split(",\nzs")[0]))
def win_rescale(spark, sf):
    s = _z(spark, sf).withColumn("hi", F.max("s").over(Window.partitionBy("concept")))
    return s.where("s >= 0.1").select("id", "concept", F.round(F.when(F.col("hi") <= 0.1, 1.0).otherwise((F.col("s") - 0.1) / (F.col("hi") - 0.1)), 6).alias("scaled"))


@query(sql("vectors", "select id, concept from sims qualify row_number() over (partition by id order by s * (1 - concept * 0.01) desc, concept) = 1", CENT, ZS.split(",\nzs")[0]))
def win_home(spark, sf):
    w = Window.partitionBy("id").orderBy(F.desc(F.col("s") * (1 - F.col("concept") * 0.01)), "concept")
    return _z(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "concept")


TOP8 = "tops as (select concept, id, s, row_number() over (partition by concept order by s desc, id) as k from sims)"


def _tops(spark, sf, k):
    """The k best rows of each concept: tasks send k candidates, so no task ranks all rows of one."""
    ship(spark)
    v = vectors(spark, sf)
    c = op.centroid(v, "label").select((-1 - F.col("label")).alias("id"), "vec")  # ids of their own
    return op.knn(c, v, k).select((-1 - F.col("qid")).alias("concept"), "id", F.col("score").alias("s"), F.col("rank").alias("k"))


@query(sql("vectors", "select concept, round(avg(s), 6) as strength from tops where k <= 8 group by concept", CENT, ZS.split(",\nzs")[0], TOP8))
def agg_strength(spark, sf):
    return _tops(spark, sf, 8).groupBy("concept").agg(F.round(F.avg("s"), 6).alias("strength"))


@query(sql("vectors", "select concept, label, n from (select concept, v.label, count(*) as n, row_number() over (partition by concept order by count(*) desc, v.label) as r from tops join vectors v using (id) where k <= 24 group by concept, v.label) where r = 1", CENT, ZS.split(",\nzs")[0], TOP8))
def agg_votes(spark, sf):
    votes = _tops(spark, sf, 24).join(vectors(spark, sf).select("id", "label"), "id").groupBy("concept", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("concept").orderBy(F.desc("n"), "label")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("concept", "label", "n")


@query(sql("vectors", "select concept, count(*) as hits, count(*) filter (id % 4 = 0) as named, round(avg(s) filter (k <= 8), 6) as strength, count(*) >= 5 and (count(*) filter (id % 4 = 0) >= 5 or avg(s) filter (k <= 8) >= 0.58) as good from tops where s >= 0.2 group by concept", CENT, ZS.split(",\nzs")[0], TOP8))
def q_brief_gates(spark, sf):
    hits = _z(spark, sf).where("s >= 0.2").groupBy("concept").agg(F.count("*").alias("hits"), F.count_if(F.col("id") % 4 == 0).alias("named"))
    strength = _tops(spark, sf, 8).where("s >= 0.2").groupBy("concept").agg(F.avg("s").alias("st"))
    out = hits.join(F.broadcast(strength), "concept", "left")  # a row for each label
    good = (F.col("hits") >= 5) & ((F.col("named") >= 5) | (F.col("st") >= 0.58))
    return out.select("concept", "hits", "named", F.round("st", 6).alias("strength"), F.coalesce(good, F.lit(False)).alias("good"))


@query(sql("vectors", "select concept, count(*) filter (id % 4 = 0) as named from tops where k <= 40 group by concept", CENT, ZS.split(",\nzs")[0], TOP8))
def agg_named(spark, sf):
    return _tops(spark, sf, 40).groupBy("concept").agg(F.count_if(F.col("id") % 4 == 0).alias("named"))


@query(sql("vectors", "select concept, strength, round((case when concept % 3 = 0 then 10 else 0 end) + 0.7 * (0.5 + strength), 6) as key from (select concept, round(avg(s), 6) as strength from tops where k <= 8 group by concept)", CENT, ZS.split(",\nzs")[0], TOP8))
def sort_order_key(spark, sf):
    t = _tops(spark, sf, 8).groupBy("concept").agg(F.round(F.avg("s"), 6).alias("strength"))
    return t.withColumn("key", F.round(F.when(F.col("concept") % 3 == 0, 10).otherwise(0) + 0.7 * (0.5 + F.col("strength")), 6))


def q_mmr(spark, sf):
    """Diverse picks for each label from its best 160: greedy, so without SQL."""
    ship(spark)
    pool = _tops(spark, sf, 160).join(vectors(spark, sf).select("id", "vec"), "id")
    names = entries(spark, sf).select("id", "dir")
    pool = pool.join(names, "id", "left").select(F.col("concept").alias("card"), "id", F.coalesce("dir", F.lit("")).alias("dir"), F.col("s").alias("score"), "vec")
    return op.mmr(pool, 20)


query()(q_mmr)


@query(sql("vectors", "select label, id from (select label, id, row_number() over (partition by label order by id) - 1 as i, count(*) over (partition by label) as n from vectors) where n <= 16 or list_contains(list_transform(range(0, 16), lambda k: (k * n) // 16), i)"))
def win_sample_spread(spark, sf):
    by = Window.partitionBy("label")
    v = vectors(spark, sf).select("label", "id").withColumns({"i": F.row_number().over(by.orderBy("id")) - 1, "n": F.count("*").over(by)})
    places = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.floor(k * F.col("n") / 16))
    return v.where((F.col("n") <= 16) | F.array_contains(places, F.col("i").cast("long"))).select("label", "id")


COPIES = "x as (select id, case when id % 3 = 0 then null else md5((id % 40)::varchar) end as h, id * 7 % 101 as r from vectors)"


@query(sql("vectors", "select id, first(id) over w as representative, min(r) over w as rank from x window w as (partition by coalesce('h:' || h, 'id:' || id) order by r, id rows between unbounded preceding and unbounded following)", COPIES))
def agg_collapse_dups(spark, sf):
    v = vectors(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.md5((F.col("id") % 40).cast("string"))).alias("h"), (F.col("id") * 7 % 101).alias("r"))
    return op.representatives(v, F.col("h"), F.col("r"))
