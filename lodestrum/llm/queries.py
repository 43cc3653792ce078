"""The registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrum.llm.bpe import encode_digests
from lodestrum.llm.common import table
from lodestrum.llm.exact_dedup import exact_groups
from lodestrum.llm.hard_negatives import hard_negatives
from lodestrum.llm.html_tree import main_text
from lodestrum.llm.mixing import mix
from lodestrum.llm.near_dedup import near_groups
from lodestrum.llm.packing import pack
from lodestrum.llm.quality_cnn import quality_scores
from lodestrum.llm.quality_rules import quality_rules
from lodestrum.llm.sharding import ring_shards
from lodestrum.llm.token_counts import token_counts
from lodestrum.llm.toxicity import toxicity_scores
from lodestrum.llm.whitening import whitened_rows


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_quality_rules, op3_bpe, op4_toxicity, op5_token_counts, op6_ring_shards, op7_quality_cnn, op8_html_extract, op9_pack, op10_near_dedup, op11_mix, op12_whiten, op13_hard_negatives)}

ORACLES = {
    "op1_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id,
       first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by length(t) desc, doc_id) = 1 as kept,
       sha256(norm) as text_sha256
from d
""",
    "op2_quality_rules": r"""
with d as (
  select doc_id, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as w from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
covered as (select doc_id, sum(gap)::bigint as n from (select doc_id, least(5, coalesce(i - lag(i) over (partition by doc_id order by i), 5)) as gap from twice) group by doc_id),
m as (
  select doc_id, t, len(words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from d left join covered using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or (n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines)
            or word_chars < 2 * n_words or word_chars > 25 * n_words
            or 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars
            or 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars
            or (4 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words and n_words > 20)) as kept
from b
""",
    "op11_mix": r"""
with d as (
  select doc_id, source, coalesce(text, '') as t,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
         (('0x' || md5(coalesce(doc_id::varchar, '') || '|11|' || md5(coalesce(text, ''))).substr(1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from documents),
k as (select doc_id, source, size, -ln(u) / ((length(regexp_replace(t, '[^\p{L}]+', '', 'g')) + 1)::double / (length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) + 1)) as key from d),
s as (select source, sum(size)::bigint as source_size, [5.0::double, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as w from k group by source),
-- with sources cut in the order of the levels at which they reach their cap, the level rises until the right ones are cut
o as (select *, coalesce(sum(3 * source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as cut,
             sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as open, sum(source_size) over () as total from s),
l as (select max((total - cut) / open) as level from o),
p as (select source, source_size, least((3 * source_size)::double, w * level) as target from s, l),
q as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as whole from p),
b as (select *, greatest(target - whole * source_size, 0) as budget from q),
r as (select k.doc_id, k.size, k.key, b.*, sum(k.size) over (partition by b.source order by k.key, k.doc_id) as upto from k join b on k.source is not distinct from b.source),
e as (select *, upto <= budget and budget > 0 as inside, budget - max(case when upto <= budget then upto else 0 end) over (partition by source) as rest from r),
f as (select *, row_number() over (partition by source, inside order by abs(size - rest), key, doc_id) as n from e)
select doc_id, size, source_size, target, ((whole + (inside or (n = 1 and abs(size - rest) < rest))::bigint) * size)::bigint as taken from f
""",
    "op13_hard_negatives": r"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, row_number() over () as n,
         list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
  from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as (
  select a.vec_id as anchor_id, a.n as a, b.vec_id as id, b.n, a.label = b.label as alike,
         list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2]))::bigint as score
  from r a, r b where a.vec_id % 100 = 0 and a.n <> b.n),
f as (select * from p where alike qualify row_number() over (partition by a order by score desc, id) <= 5)
select f.anchor_id, f.id as positive_id, (row_number() over (partition by f.a, f.n order by p.score desc, p.id))::int as rank, p.id as negative_id,
       f.score as positive_score, p.score as negative_score
from f join p on f.a = p.a and not p.alike and 80 * f.score <= 100 * p.score and p.score <= f.score
qualify row_number() over (partition by f.a, f.n order by p.score desc, p.id) <= 5
""",
}
