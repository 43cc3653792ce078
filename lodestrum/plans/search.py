"""Queries of text functions and of lexical, vector and hybrid search."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.functions import text as tx
from lodestrum.functions.translate import translate
from lodestrum.functions.vector import dot
from lodestrum.operators import search as op
from lodestrum.operators.postings import Postings
from lodestrum.plans.registry import query
from lodestrum.session import shared
from lodestrum.sources.tables import entries, sql, table, vectors

Q, WORDY = "red widgets", "smallest blue rings"
FIELDS = {"name": "nt", "folder": "ft", "top": "tt"}
TOKENS = f"tok as (select *, {tx.sql_doc_tokens('name')} as nt, {tx.sql_doc_tokens('dir')} as ft, {tx.sql_doc_tokens('top_level')} as tt from entries)"


def sql_lexical(text: str, limit: int, name: str = "lex") -> str:
    terms = tx.query_terms(text)
    scores = ", ".join(f"{tx.sql_term_score(t, FIELDS)} as s{i}" for i, t in enumerate(terms))
    total, matched = " + ".join(f"s{i}" for i in range(len(terms))), " + ".join(f"(s{i} > 0)::int" for i in range(len(terms)))
    need = -(-len(terms) // 2) if len(terms) > 1 else len(terms)
    return f"""{name}_all as (select id, name, mtime, ({total})::bigint as score, {matched} as matched from (select *, {scores} from tok)),
{name}_hits as (select *, matched = {len(terms)} as is_full from {name}_all where matched >= {need}),
{name} as (select id, score, row_number() over (order by is_full desc, matched desc, score desc, mtime desc, name, id) - 1 as rank, not is_full as partial
  from {name}_hits where is_full or not exists (select 1 from {name}_hits where is_full) qualify rank < {limit})"""


def _index(spark, sf):
    return op.indexed(entries(spark, sf))


@query(sql("entries", "select id, score, rank, partial from lex", TOKENS, sql_lexical(Q, 200)))
def q_lexical(spark, sf):
    return op.lexical(_index(spark, sf), Q)


@query(sql("entries", "select id, score, rank, partial from lex", TOKENS, sql_lexical(WORDY, 500)))
def q_lexical_stored(spark, sf):
    """An index with former names of one top folder, which a second generation puts right."""
    e = entries(spark, sf)
    here = F.col("top_level") == "Brand#1"
    index = Postings.create(e.withColumn("name", F.when(here, F.concat(F.lit("smallest blue ring "), "name")).otherwise(F.col("name"))), f"{shared(spark)}/names-{uuid4().hex}")
    index.put(e.where(here))
    return index.search(WORDY, 500)


@query(sql("entries", "select id, score, rank, partial from lex", TOKENS, sql_lexical("zzz " + Q, 100)))
def fn_partial(spark, sf):
    return op.lexical(_index(spark, sf), "zzz " + Q, 100)


@query(sql("entries", f"select id, {tx.sql_match(tx.query_terms('whee')[0], 'nt')}::bigint as head, {tx.sql_match(tx.query_terms('idget')[0], 'nt')}::bigint as tail, {tx.sql_match(tx.query_terms('ring')[0], 'nt')}::bigint as exact from tok", TOKENS))
def fn_matchweight(spark, sf):
    m = lambda w: tx.match_weight(tx.query_terms(w)[0], F.col("name_tokens")).cast("long")
    return _index(spark, sf).select("id", m("whee").alias("head"), m("idget").alias("tail"), m("ring").alias("exact"))


@query(sql("entries", f"select id, {tx.sql_term_score(tx.query_terms('brand')[0], FIELDS)}::bigint as score from tok", TOKENS))
def fn_fieldscore(spark, sf):
    return _index(spark, sf).select("id", tx.term_score(tx.query_terms("brand")[0], {f: F.col(f"{f}_tokens") for f in tx.FIELDS}).cast("long").alias("score"))


def sql_bilingual(text: str, limit: int) -> str:
    return f"""{sql_lexical(text, limit, 'l1')},
{sql_lexical(translate(text)[0], limit, 'l2')},
both_ as (select *, max(case when partial then 0 else 1 end) over () as any_full, min(src) over () as first_src from (select *, 0 as src from l1 union all select *, 1 from l2)),
once as (select id, min((src, rank, score, partial)) as b from both_ where case when any_full = 1 then not partial else src = first_src end group by id),
found as (select id, b[3] as score, row_number() over (order by b[1], b[2]) - 1 as rank, b[4] as partial, b[1]::bigint as src from once qualify rank < {limit})"""


@query(sql("entries", "select id, score, rank, partial, src from found", TOKENS, sql_bilingual("anillo rojo", 300)))
def q_lexical_bilingual(spark, sf):
    """A Spanish query over English names: only its translation finds them."""
    return op.bilingual(_index(spark, sf), "anillo rojo", 300)


@query(sql("entries", "select id, src from found", TOKENS, sql_bilingual("red varilla", 300)))
def set_lexical_union(spark, sf):
    """Half of the words are found as they are; the translation finds all of them, so partial matches don't count."""
    return op.bilingual(_index(spark, sf), "red varilla", 300).select("id", "src")


@query(sql("entries", "select id, name from entries where instr(lower(name), 'ed wi') > 0 or instr(lower(dir), 'ed wi') > 0 or instr(lower(top_level), 'ed wi') > 0"))
def fn_legacy_substring(spark, sf):
    has = lambda c: F.contains(F.lower(c), F.lit("ed wi"))
    return entries(spark, sf).where(has(F.col("name")) | has(F.col("dir")) | has(F.col("top_level"))).select("id", "name")


@query("select doc_id as id, md5(strip_accents(lower(text))) as folded from documents")
def fn_fold(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(tx.fold(F.lower("text"))).alias("folded"))


@query(f"select doc_id as id, len(t)::bigint as n, md5(array_to_string(t, ' ')) as hash from (select doc_id, {tx.sql_tokens('text')} as t from documents)")
def fn_tokenize(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.tokenize(F.col("text")).alias("t"))
    return d.select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("hash"))


@query(f"select item_id as id, md5(array_to_string(list_sort(t), ' ')) as hash, len(t)::bigint as n from (select item_id, {tx.sql_doc_tokens('text')} as t from benchmark)")
def fn_doctokens(spark, sf):
    d = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), tx.doc_tokens(F.col("text")).alias("t"))
    return d.select("id", F.md5(F.array_join(F.sort_array("t"), " ")).alias("hash"), F.size("t").cast("long").alias("n"))


WORDS = f"words as (select distinct unnest({tx.sql_tokens('text')}) as w from benchmark)"


def _words(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(tx.tokenize(F.col("text"))).alias("w")).distinct()


@query(f"with {WORDS} select w, {tx.sql_stem('w')} as s from words")
def fn_stem(spark, sf):
    return _words(spark, sf).select("w", tx.stem(F.col("w")).alias("s"))


@query(f"with {WORDS} select w, {tx.sql_undouble('w')} as s from words")
def fn_undouble(spark, sf):
    return _words(spark, sf).select("w", tx.undouble(F.col("w")).alias("s"))


STOPS = sorted(tx.STOP)


@query(f"select item_id as id, case when len(c) > 0 then array_to_string(c, ' ') else array_to_string(t, ' ') end as words from (select item_id, t, list_filter(t, lambda x: not list_contains({STOPS}, x)) as c from (select item_id, {tx.sql_tokens('text')} as t from benchmark))")
def fn_stopwords(spark, sf):
    d = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), tx.tokenize(F.col("text")).alias("t"))
    d = d.withColumn("c", F.filter("t", lambda x: ~x.isin(STOPS)))
    return d.select("id", F.array_join(F.when(F.size("c") > 0, F.col("c")).otherwise(F.col("t")), " ").alias("words"))


PAIRS = [(w, a) for g in tx.ALIAS_GROUPS for w in g for a in tx.aliases(w)]


@query("with a(w, alt) as (values " + ", ".join(f"('{w}', '{a}')" for w, a in PAIRS) + "), n as (select doc_id as id, (array['expl', 'metal', 'fs', 'none', 'voice'])[doc_id % 5 + 1] as w from documents) select id, n.w, alt from n join a on a.w = n.w")
def fn_alias(spark, sf):
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.element_at(F.array(*map(F.lit, ("expl", "metal", "fs", "none", "voice"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("w"))
    return n.join(F.broadcast(spark.createDataFrame(PAIRS, "w string, alt string")), "w").select("id", "w", "alt")


QVEC = "qv as (select vec as qvec from vectors where id = 7)"
TOPV = """scored_ as (select id, list_dot_product(vec, qvec) as score from vectors, qv),
topv as (select id, score from scored_ order by score desc, id limit {k}),
cutv as (select id, score, floor_ from (select *, greatest(least(0.30, max(score) over () - 0.05), max(score) over () - 0.25) as floor_ from topv) where score >= floor_)"""


def _qvec(spark, sf):
    return vectors(spark, sf).where("id = 7").select(F.col("vec").alias("qvec"))


@query(sql("vectors", "select id, round(score, 6) as score from cutv", QVEC, TOPV.format(k=100)))
def q_vector(spark, sf):
    return op.vector_top(vectors(spark, sf), _qvec(spark, sf), 100).select("id", F.round("score", 6).alias("score"))


@query(sql("vectors", "select id, round(score, 6) as score, round(floor_, 6) as floor from cutv", QVEC, TOPV.format(k=50)))
def filt_cutoff(spark, sf):
    return op.vector_top(vectors(spark, sf), _qvec(spark, sf), 50).select("id", F.round("score", 6).alias("score"), F.round("floor", 6).alias("floor"))


@query(sql("vectors", "select id, round(score, 6) as score from topv", QVEC, TOPV.format(k=25)))
def topk_vector(spark, sf):
    return op.vector_top(vectors(spark, sf), _qvec(spark, sf), 25, cut=False).select("id", F.round("score", 6).alias("score"))


@query(sql("vectors entries", "select id, round(score, 6) as score from cutv", "qv as (select vec as qvec from vectors where id = 7)", TOPV.format(k=40).replace("from vectors, qv", "from vectors, qv where id in (select id from entries where top_level = 'Brand#1')")))
def q_vector_scoped(spark, sf):
    scope = entries(spark, sf).where("top_level = 'Brand#1'").select("id")
    return op.vector_top(vectors(spark, sf).join(scope, "id", "left_semi"), _qvec(spark, sf), 40).select("id", F.round("score", 6).alias("score"))


@query(sql("vectors entries", "select e.id, round(list_dot_product(vec, qvec), 6) as score from entries e left join vectors v using (id), qv where e.size % 3 = 0", QVEC))
def q_score(spark, sf):
    named = entries(spark, sf).where("size % 3 = 0").select("id")
    return named.join(vectors(spark, sf), "id", "left").join(F.broadcast(_qvec(spark, sf))).select("id", F.round(dot(F.col("vec"), F.col("qvec")), 6).alias("score"))


HYBRID = f"""hits as (select l.id, score_ as score, case when score_ is null or score_ >= (select coalesce(max(floor_), 0) from cutv) then 1 else 3 end as tier, rank, 'name' as match
  from (select id, rank from lex where not partial) l left join (select id, score as score_ from scored_) s using (id)),
ear as (select id, score, 2 as tier, 0 as rank, case when id in (select id from hits) then 'name' else 'ai' end as match from cutv where id in (select id from entries)),
every_ as (select * from hits union all select * from ear),
first_ as (select * from every_ qualify row_number() over (partition by id order by tier) = 1)"""


@query(sql("entries vectors", "select row_number() over (order by tier, coalesce(score, -2) desc, rank, id) - 1 as place, id, round(score, 6) as score, match from first_ qualify place < 500", TOKENS, sql_lexical(Q, 5000), QVEC, TOPV.format(k=500), HYBRID))
def q_hybrid(spark, sf):
    names = op.lexical(_index(spark, sf), Q, 5000, partial=False).where("not partial")
    v, q = vectors(spark, sf), _qvec(spark, sf)
    ai = op.vector_top(v, q, 500).join(entries(spark, sf).select("id"), "id", "left_semi")
    scores = v.join(F.broadcast(q)).select("id", dot(F.col("vec"), F.col("qvec")).alias("score"))
    return op.hybrid(names, scores, ai, 500)


@query(sql("entries vectors", "select id, min(tier)::bigint as tier from every_ group by id", TOKENS, sql_lexical(Q, 5000), QVEC, TOPV.format(k=500), HYBRID))
def set_union_dedupe(spark, sf):
    names = op.lexical(_index(spark, sf), Q, 5000, partial=False).where("not partial").select("id")
    v, q, known = vectors(spark, sf), _qvec(spark, sf), entries(spark, sf).select("id")
    ai = op.vector_top(v, q, 500)
    floor = ai.agg(F.coalesce(F.max("floor"), F.lit(0.0)).alias("floor"))
    s = names.join(v.join(F.broadcast(q)).select("id", dot(F.col("vec"), F.col("qvec")).alias("score")), "id", "left").join(F.broadcast(floor))
    tiers = s.select("id", F.when(F.col("score").isNull() | (F.col("score") >= F.col("floor")), 1).otherwise(3).alias("tier"))
    return tiers.union(ai.join(known, "id", "left_semi").select("id", F.lit(2))).groupBy("id").agg(F.min("tier").cast("long").alias("tier"))


@query(sql("entries", f"select id, rank from (select id, row_number() over (partition by top_level order by size desc, mtime desc, name) as rank from entries) where rank <= 5"))
def win_rank_topk(spark, sf):
    w = Window.partitionBy("top_level").orderBy(F.desc("size"), F.desc("mtime"), "name")
    return entries(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("id", F.col("rank").cast("long").alias("rank"))
