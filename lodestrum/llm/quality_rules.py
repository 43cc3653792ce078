"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean expression over measures of a text that rejects it. A bounded sample gives each rule's cost (the
seconds that it and the measures it needs take) and selectivity (the share it rejects); rules then run in the order of
rejection per cost. A measure is made when the first rule needs it, and only for rows that no earlier rule has rejected.
The verdict doesn't depend on the order, only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.common import SPACE

WINDOW = 5
#: The sample on which costs and rejections are estimated: rows, the characters beyond which a text isn't drawn, one row
#: of how many is, and how often the sample is repeated to tell its cost from a job's own.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_OF, REPEATS = 200, 1 << 18, 16, 4
SYMBOLS = "#*$%&|<>"


def length_without(letters: str) -> Column:
    """Characters of the text less those that match."""
    return F.length(F.regexp_replace("text", letters, "")).cast("long")


def _words(df: DataFrame, made: Callable[[Column], Column]) -> DataFrame:
    df = df.withColumn("words", made(F.filter(F.split("text", rf"[{SPACE}]+"), lambda w: w != "")))
    return df.withColumn("n_words", made(F.size("words").cast("long")))


def _lines(df: DataFrame, made: Callable[[Column], Column]) -> DataFrame:
    df = df.withColumn("lines", made(F.filter(F.split("text", "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))))
    return df.withColumns({"n_lines": made(F.size("lines").cast("long")), "n_dup_lines": made((F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))}).drop("lines")


def _repeats(df: DataFrame, made: Callable[[Column], Column]) -> DataFrame:
    """Words in windows that are found twice or more.

    A two-step check: the hashes of all windows are compared as sets, and only where two agree are the windows themselves
    sorted and compared, so the count is exact and most texts never get there. The intermediate columns are used more
    than once each, so that the planner keeps them as columns.
    """
    df = df.withColumn("hashes", made(F.transform("words", lambda w: F.xxhash64(w))))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))))
    df = df.withColumn("keys", made(F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(windows)))
    df = df.withColumn("repeats", made(F.size(F.array_distinct("keys")) < F.size("keys")))
    df = df.withColumn("sorted", F.when(F.col("repeats"), F.array_sort(F.transform("keys", lambda _, i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))))))
    equal = lambda a, b: F.get("sorted", a)["w"] == F.get("sorted", b)["w"]
    twice = lambda k: F.coalesce(equal(k, k + 1), F.lit(False)) | (F.when(k > 0, F.coalesce(equal(k, k - 1), F.lit(False))).otherwise(False))
    found = F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), twice), lambda k: F.get("sorted", k)["i"])
    df = df.withColumn("starts", F.when(F.col("repeats"), F.array_sort(found)))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).cast("int").alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"]).cast("long")).alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )
    counted = made(F.when(F.col("repeats"), covered).otherwise(F.lit(0).cast("long")))
    return df.withColumn("n_repeat_words", counted).drop("hashes", "keys", "repeats", "sorted", "starts")


def _length(name: str, others: str) -> Callable[[DataFrame, Callable[[Column], Column]], DataFrame]:
    return lambda df, made: df.withColumn(name, made(length_without(others)))


#: How each measure is added to (doc_id, text, ...). `made` puts a condition before an expression.
MEASURES: dict[str, Callable[[DataFrame, Callable[[Column], Column]], DataFrame]] = {
    "n_words": _words,
    "n_dup_lines": _lines,
    "n_repeat_words": _repeats,
    "word_chars": _length("word_chars", rf"[{SPACE}]+"),
    "n_symbols": _length("n_symbols", rf"[^{SYMBOLS}]+"),
    "n_letters": _length("n_letters", r"[^\p{L}]+"),
    "n_capitals": _length("n_capitals", r"[^\p{Lu}]+"),
    "n_exclaims": _length("n_exclaims", "[^!]+"),
}
#: What the contract returns of every row, whatever the verdict.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: an expression over measures; true means that the text goes. needs: those measures, n_words apart."""

    name: str
    rejects: str
    needs: tuple[str, ...] = ()


#: The base rules decide base_failed.
BASE = (Rule("few_words", "n_words < 10"), Rule("repeated_words", "100 * n_repeat_words > 20 * n_words", ("n_repeat_words",)))
#: Conservative bounds: what they reject is markup, shouting or lists, not prose in any language.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words", ("n_symbols",)),
    Rule("dup_lines", "n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines", ("n_dup_lines",)),
    Rule("short_words", "word_chars < 2 * n_words", ("word_chars",)),
    Rule("long_words", "word_chars > 25 * n_words", ("word_chars",)),
    Rule("few_letters", "2 * n_letters < word_chars", ("n_letters", "word_chars")),
    Rule("shouting", "2 * n_capitals > word_chars", ("n_capitals", "word_chars")),
    Rule("exclaiming", "4 * n_exclaims > n_words and n_words > 20", ("n_exclaims",)),
)


def measured(df: DataFrame, names: tuple[str, ...], only: Column | None = None) -> DataFrame:
    """df with those of the measures that it doesn't have yet, null where `only` doesn't hold."""
    made = (lambda c: c) if only is None else (lambda c: F.when(only, c))
    for name in names:
        if name not in df.columns:
            df = MEASURES[name](df, made)
    return df


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], given: tuple[str, ...] = ("n_words",), rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, of: int = SAMPLE_OF) -> list[Rule]:
    """Rules by rejections per second on a sample of whole texts, drawn by hash; without rows, the order given.

    `given` are measures that every row has anyway and that cost a rule nothing. A rule is run over the sample several
    times over; its cost is what it takes beyond a rule that does nothing, so that the time of starting a job isn't in it.
    """
    spark = docs.sparkSession
    drawn = docs.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(of)) == 0) & (F.length("text") <= chars))
    sample = drawn.select("doc_id", "text").take(rows)  # reads no more of the table than it takes to find them
    if not sample:
        return list(rules)
    known = measured(spark.createDataFrame([tuple(r) for r in sample], "doc_id long, text string").coalesce(1), given).cache()

    def run(rule: Rule, times: int) -> tuple[float, int]:
        again = known.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        n = measured(again, rule.needs).agg(F.count_if(F.expr(rule.rejects))).first()[0]
        return time.perf_counter() - began, n

    nothing = Rule("nothing", "n_words < 0")
    run(nothing, REPEATS)
    idle = run(nothing, REPEATS)[0]
    rates = []
    for at, rule in enumerate(rules):
        seconds, rejected = min(run(rule, REPEATS) for _ in range(2))  # the first one compiles
        rates.append((-rejected / max(seconds - idle, 1e-3), at))
    known.unpersist()
    return [rules[at] for _, at in sorted(rates)]


def cascade(df: DataFrame, rules: list[Rule], alive: Column | None = None) -> DataFrame:
    """Adds rejected_by, the name of the first rule that rejects, or null. Only rows that satisfy `alive` are looked at, and
    of these each rule and its measures only where no earlier one has rejected."""
    first = F.lit(True) if alive is None else alive
    df = df.withColumns({"rejected_by": F.lit(None).cast("string"), "_alive": first})
    for rule in rules:
        df = measured(df, rule.needs, F.col("_alive"))
        # Used three times below, so the planner keeps it as a column and makes it once.
        df = df.withColumn("_out", F.when(F.col("_alive"), F.coalesce(F.expr(rule.rejects), F.lit(False))).otherwise(False))
        df = df.withColumns({"rejected_by": F.when(F.col("_out"), F.lit(rule.name)).otherwise(F.col("rejected_by")), "_alive": F.col("_alive") & ~F.col("_out")}).drop("_out")
    return df


def _fenced(name: str, kind: str) -> Column:
    """A column behind something that isn't deterministic, which keeps a later filter above this step; pushed below, it would
    repeat the work for each word."""
    return F.when(F.monotonically_increasing_id() < 0, F.lit(None).cast(kind)).otherwise(F.col(name)).alias(name)


def _docs(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the reported measures, base_failed, kept and rejected_by for every row.

    A null or empty text has no words, fails the base rules and goes. Repeated rows are judged alike, each by itself; texts
    of any length are read whole; an empty table gives no rows; further columns are ignored. Of several rules that reject
    a text, rejected_by names the one that came first in the sample's order; kept doesn't depend on that.
    """
    docs = _docs(df, id_col, text_col)
    ordered = order_rules(docs, rules, given=("n_words", *REPORTED))
    base = F.expr(" or ".join(f"({r.rejects})" for r in BASE))
    out = measured(docs, REPORTED).withColumn("base_failed", base)
    out = cascade(out, ordered, ~F.col("base_failed"))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.col("rejected_by")))
    return out.select("doc_id", _fenced("n_words", "long"), *REPORTED[1:], "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that every rule lets pass, the base rules among them, with all their columns.

    Each row has its own verdict, whatever its id. Nothing but the verdict is asked for here, so the base rules take their
    place in the cascade like the others.
    """
    ordered = order_rules(_docs(df, id_col, text_col), (*BASE, *rules))
    docs = measured(_docs(df, id_col, text_col, F.struct("*").alias("_whole")), ("n_words",))
    out = cascade(docs, ordered).select(_fenced("_alive", "boolean"), "_whole")
    return out.where("_alive").select("_whole.*")
