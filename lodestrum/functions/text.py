"""Tokens, stems and match weights as JVM expressions. Queries are parsed on the driver; rows never leave the JVM."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a query doesn't need, and groups of words that stand for each other, by stem.
STOP = set("a an the of on in at to for with and or by from into onto sound sounds sfx fx".split())
ALIAS_GROUPS = [
    ["impact", "impt"],
    ["whoosh", "whsh", "swoosh"],
    ["explosion", "expl", "explo"],
    ["ambience", "ambient", "amb", "ambi", "atmos", "atmo"],
    ["designed", "dsgn"],
    ["weapon", "wpn"],
    ["vehicle", "veh"],
    ["creature", "crea", "creat"],
    ["metal", "mtl", "metallic"],
    ["water", "wtr"],
    ["voice", "vox", "vocal"],
    ["footstep", "fs", "ftsp"],
    ["gunshot", "gun"],
    ["foley", "foly"],
    ["user interface", "ui", "gui"],
    ["electric", "elec"],
    ["mechanical", "mech"],
    ["magic", "mgc"],
    ["destruction", "dstr", "destr"],
    ["glass", "gls"],
    ["scifi", "sci"],
]
#: Weights of the ways to match, and of the fields.
EXACT, ALIAS, PREFIX, TAIL = 3, 2, 2, 1
FIELDS = {"name": 6, "folder": 3, "top": 2}
NOT_WORD = r"[^\p{L}\p{N}]+"


def _folds() -> tuple[str, str]:
    """Letters with marks and their bases, then the marks themselves, which go."""
    source, target = "", ""
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(base) == 1 and base != c:
            source, target = source + c, target + base
    return source + "".join(map(chr, range(0x300, 0x370))), target


FOLD_FROM, FOLD_TO = _folds()


def fold(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def tokenize(text: Column) -> Column:
    return F.filter(F.split(fold(F.lower(text)), NOT_WORD), lambda t: t != "")


def undouble(t: Column) -> Column:
    last, prev = F.substring(t, -1, 1), F.expr("0")
    prev = F.substring(t, F.length(t) - 1, F.lit(1))
    return F.when((F.length(t) > 3) & (last == prev) & ~last.isin(*"aeiouls"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n <= 3) | t.rlike(r"\d"), t)
        .when((n > 5) & t.endswith("ing"), undouble(cut(3)))
        .when((n > 4) & t.endswith("ied"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & t.endswith("ed") & ~t.endswith("eed"), undouble(cut(2)))
        .when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(t.rlike("(ss|us|is)$"), t)
        .when(t.rlike("(sh|ch|x|z|ss)es$"), cut(2))
        .when(t.endswith("s"), cut(1))
        .otherwise(t)
    )


def spaced(text: Column) -> Column:
    """A space at changes of case and between letters and digits."""
    for pattern in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        text = F.regexp_replace(text, pattern, "$1 $2")
    return text


def plain_tokens(text: Column) -> Column:
    return F.array_distinct(F.concat(tokenize(text), tokenize(spaced(text))))


def with_stems(tokens: Column) -> Column:
    """Tokens and their stems; give it a column of tokens, not an expression, which would be worked out twice."""
    return F.array_distinct(F.concat(tokens, F.transform(tokens, stem)))


def doc_tokens(text: Column) -> Column:
    return with_stems(plain_tokens(text))


# queries, on the driver


def py_fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)


def py_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", py_fold(text.lower()))


def py_undouble(t: str) -> str:
    return t[:-1] if len(t) > 3 and t[-1] == t[-2] and t[-1] not in "aeiouls" else t


def py_stem(t: str) -> str:
    """As stem(): the first ending that applies goes."""
    if len(t) <= 3 or any(c.isdigit() for c in t):
        return t
    if len(t) > 5 and t.endswith("ing"):
        return py_undouble(t[:-3])
    if len(t) > 4 and t.endswith(("ied", "ies")):
        return t[:-3] + "y"
    if len(t) > 4 and t.endswith("ed") and not t.endswith("eed"):
        return py_undouble(t[:-2])
    if t.endswith(("ss", "us", "is")):
        return t
    if t.endswith(("shes", "ches", "xes", "zes", "sses")):
        return t[:-2]
    return t[:-1] if t.endswith("s") else t


@dataclass(frozen=True)
class Term:
    word: str
    stem: str
    alternates: tuple[str, ...]
    bare: str | None


def aliases(word: str) -> tuple[str, ...]:
    return tuple(x for g in ALIAS_GROUPS if word in g for x in g if x != word and " " not in x)


def query_terms(text: str) -> list[Term]:
    """Distinct words of a query with stems, alternates and bare forms; function words only where there is nothing else."""
    words = list(dict.fromkeys(py_tokens(text)))
    words = [w for w in words if w not in STOP] or words
    if sum(map(len, words)) < 2:
        return []
    return [Term(w, s := py_stem(w), aliases(s) or aliases(w), w[:-1] if len(w) >= 5 and w.endswith("e") else None) for w in words]


def terms(text: Column) -> Column:
    """The terms of every query of a column, as query_terms() has them for one: an array of word, stem and bare."""
    every = F.array_distinct(tokenize(text))
    telling = F.filter(every, lambda w: ~w.isin(sorted(STOP)))
    words = F.when(F.size(telling) > 0, telling).otherwise(every)
    bare = lambda w: F.when((F.length(w) >= 5) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1))
    found = F.transform(words, lambda w: F.struct(w.alias("word"), stem(w).alias("stem"), bare(w).alias("bare")))
    return F.when(F.length(F.array_join(words, "")) >= 2, found).otherwise(F.filter(found, lambda x: F.lit(False)))


def term_rows(rows: DataFrame, text: Column) -> DataFrame:
    """The rows of a table with each term of their text as a query: word, stem and bare beside the other columns. As terms() has
    them, but every step is a column, so a text is tokenised once, and a form that nobody asks for isn't made."""
    every, words = "_every", "_words"
    d = rows.withColumn(every, F.array_distinct(tokenize(text)))
    d = d.withColumn(words, F.filter(every, lambda w: ~w.isin(sorted(STOP))))
    d = d.withColumn(words, F.when(F.size(words) > 0, F.col(words)).otherwise(F.col(every))).drop(every)
    # Words have a letter at least, so only one word alone can be too short. The filter asks for what explode makes, or it would
    # be pushed below and make the words again, as would the one that explode() without empty rows brings with it.
    d = d.select("*", F.size(words).alias("_n"), F.explode_outer(words).alias("word")).drop(words)
    d = d.where(F.col("word").isNotNull() & ((F.col("_n") > 1) | (F.length("word") >= 2))).drop("_n")
    w = F.col("word")
    return d.withColumns({"stem": stem(w), "bare": F.when((F.length(w) >= 5) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1))})


def marked(text: Column, words: list[str], left: str = "[", right: str = "]") -> Column:
    """The text with signs around every place of any of the words, the longest first, whatever the case."""
    any_of = "|".join(re.escape(w) for w in sorted({w for w in words if w}, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"(?i)({any_of})", f"{left}$1{right}") if any_of else text


def necessary(term: Term) -> list[str]:
    """Texts of which one is in any folded field that the term can match: each way to match has one of its forms begin or end
    a token, and stemming changes no more than a token's last letter once its ending is gone."""
    forms = {term.word, term.stem, *term.alternates, *([term.bare] if term.bare else [])}
    return sorted({f[:-1] for f in forms})


def match_weight(term: Term, tokens: Column) -> Column:
    begins = lambda p: F.exists(tokens, lambda x: x.startswith(p))
    out = F.when(F.array_contains(tokens, term.word) | F.array_contains(tokens, term.stem), EXACT)
    if term.alternates:
        out = out.when(F.arrays_overlap(tokens, F.array(*map(F.lit, term.alternates))), ALIAS)
    out = out.when(begins(term.word), PREFIX)
    if term.bare:
        out = out.when(begins(term.bare), PREFIX)
    if len(term.word) >= 4:
        out = out.when(F.exists(tokens, lambda x: F.instr(F.substring(x, 4, 1 << 20), term.word) > 0), TAIL)
    return out.otherwise(0)


def term_score(term: Term, fields: dict[str, Column]) -> Column:
    """The best of match and field weights over the fields, 0 without a match."""
    scores = [F.when(match_weight(term, tokens) > 0, match_weight(term, tokens) + FIELDS[f]).otherwise(0) for f, tokens in fields.items()]
    return F.greatest(*scores)


# the same as SQL texts, for the oracles


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_undouble(t: str) -> str:
    return f"case when length({t}) > 3 and right({t}, 1) = substr({t}, length({t}) - 1, 1) and right({t}, 1) not in ('a','e','i','o','u','l','s') then substr({t}, 1, length({t}) - 1) else {t} end"


def sql_stem(t: str) -> str:
    cut = lambda k: f"substr({t}, 1, length({t}) - {k})"
    return f"""case when length({t}) <= 3 or regexp_matches({t}, '[0-9]') then {t}
 when length({t}) > 5 and {t} like '%ing' then {sql_undouble(cut(3))}
 when length({t}) > 4 and {t} like '%ied' then {cut(3)} || 'y'
 when length({t}) > 4 and {t} like '%ed' and {t} not like '%eed' then {sql_undouble(cut(2))}
 when length({t}) > 4 and {t} like '%ies' then {cut(3)} || 'y'
 when regexp_matches({t}, '(ss|us|is)$') then {t} when regexp_matches({t}, '(sh|ch|x|z|ss)es$') then {cut(2)}
 when {t} like '%s' then {cut(1)} else {t} end"""


def sql_spaced(x: str) -> str:
    for pattern in ("([a-z])([A-Z])", "([A-Z]+)([A-Z][a-z])", "(\\p{L})(\\p{N})", "(\\p{N})(\\p{L})"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    return x


def sql_doc_tokens(x: str) -> str:
    plain = f"list_distinct(list_concat({sql_tokens(x)}, {sql_tokens(sql_spaced(x))}))"
    return f"list_distinct(list_concat({plain}, list_transform({plain}, lambda s: {sql_stem('s')})))"


def sql_match(term: Term, tokens: str) -> str:
    some = lambda cond: f"len(list_filter({tokens}, lambda y: {cond})) > 0"
    parts = [f"when list_contains({tokens}, '{term.word}') or list_contains({tokens}, '{term.stem}') then 3"]
    if term.alternates:
        parts.append(f"when list_has_any({tokens}, {list(term.alternates)}) then 2")
    parts.append("when " + some(f"starts_with(y, '{term.word}')") + " then 2")
    if term.bare:
        parts.append("when " + some(f"starts_with(y, '{term.bare}')") + " then 2")
    if len(term.word) >= 4:
        parts.append("when " + some(f"instr(substr(y, 4), '{term.word}') > 0") + " then 1")
    return f"case {' '.join(parts)} else 0 end"


def sql_term_score(term: Term, fields: dict[str, str]) -> str:
    return "greatest(" + ", ".join(f"case when {sql_match(term, t)} > 0 then {sql_match(term, t)} + {FIELDS[f]} else 0 end" for f, t in fields.items()) + ")"
