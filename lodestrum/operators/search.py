"""Lexical search, vector search and their hybrid ranking."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.functions import text as tx
from lodestrum.functions.translate import translate
from lodestrum.functions.vector import dot

#: Fixed values of the adaptive floor: an absolute one, and distances below the best.
FLOOR, NEAR, FAR = 0.30, 0.05, 0.25


def indexed(rows: DataFrame) -> DataFrame:
    """Rows with the token sets of their fields; store this as a table to index once.

    Folders are few beside files, so their tokens are made once for each folder and joined back.
    """
    names = rows.withColumn("name_plain", tx.plain_tokens(F.col("name"))).withColumn("name_tokens", tx.with_stems(F.col("name_plain"))).drop("name_plain")
    folders = rows.select("dir", "top_level").distinct()
    folders = folders.withColumns({"f": tx.plain_tokens(F.col("dir")), "t": tx.plain_tokens(F.col("top_level"))})
    folders = folders.select(F.col("dir").alias("_dir"), F.col("top_level").alias("_top"), tx.with_stems(F.col("f")).alias("folder_tokens"), tx.with_stems(F.col("t")).alias("top_tokens"))
    return names.join(folders, names.dir.eqNullSafe(folders._dir) & names.top_level.eqNullSafe(folders._top)).drop("_dir", "_top")


def needed(terms: list[tx.Term]) -> int:
    """How many words a row must match: half of them at least."""
    return math.ceil(len(terms) / 2) if len(terms) > 1 else len(terms)


def scored(rows: DataFrame, text: str) -> DataFrame:
    """Rows that match every word, or half of the words at least: matched, score, full."""
    terms = tx.query_terms(text)
    fields = {f: F.col(f"{f}_tokens") for f in tx.FIELDS}
    need = needed(terms)
    if terms and {"name", "dir", "top_level"} <= set(rows.columns):
        # Only rows that hold a necessary part of words enough can match. The planner takes this test down to the listing,
        # before its tokens are made, where they aren't stored.
        whole = tx.fold(F.lower(F.concat_ws("/", "name", "dir", "top_level")))
        possible = sum((reduce(or_, (F.contains(whole, F.lit(p)) for p in tx.necessary(t))).cast("int") for t in terms), F.lit(0))
        rows = rows.where(possible >= need)
    if not terms:
        return rows.where(F.lit(False)).withColumns({"score": F.lit(0), "matched": F.lit(0), "full": F.lit(False)})
    # Each match is looked for once; its score is a second step.
    rows = rows.withColumns({f"m{i}_{f}": tx.match_weight(t, tokens) for i, t in enumerate(terms) for f, tokens in fields.items()})
    best = lambda i: F.greatest(*(F.when(F.col(f"m{i}_{f}") > 0, F.col(f"m{i}_{f}") + w).otherwise(0) for f, w in tx.FIELDS.items()))
    rows = rows.withColumns({f"s{i}": best(i) for i in range(len(terms))}).drop(*(f"m{i}_{f}" for i in range(len(terms)) for f in fields))
    each = [F.col(f"s{i}") for i in range(len(terms))]
    matched = sum(((c > 0).cast("int") for c in each), F.lit(0))
    rows = rows.withColumns({"score": sum(each, F.lit(0)), "matched": matched}).drop(*(f"s{i}" for i in range(len(terms))))
    return rows.where(F.col("matched") >= need).withColumn("full", F.col("matched") == len(terms))


def lexical(rows: DataFrame, text: str, limit: int = 200, partial: bool = True) -> DataFrame:
    """The best `limit` rows by score, recency and name; rows that match some words only where none matches all."""
    return best_hits(scored(rows, text), limit, partial)


def best_hits(hits: DataFrame, limit: int, partial: bool = True) -> DataFrame:
    """The best of scored hits: id, score, rank, partial."""
    keys = [F.desc("full"), F.desc("matched"), F.desc("score"), F.desc("mtime"), "name", "id"]
    top = hits.orderBy(*keys).limit(limit)
    best = top.withColumn("any_full", F.max("full").over(Window.partitionBy()))  # over `limit` rows at most
    kept = best.where(F.col("full") | (~F.col("any_full") & F.lit(partial)))
    return kept.withColumn("rank", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long")).select("id", F.col("score").cast("long").alias("score"), "rank", (~F.col("full")).alias("partial"))


def bilingual(rows, text: str, limit: int = 200, find: Callable[..., DataFrame] = lexical) -> DataFrame:
    """As lexical(), and for a query in Spanish also by its English: id, score, rank, partial, src (0: as asked, 1: in English).
    Rows are whatever `find` searches: rows with their tokens, or a stored index.

    Full matches of the query come first, then those of the translation that it hasn't got. Where there are none, partial
    matches of the query, or else of the translation.
    """
    english, changed = translate(text)
    found = find(rows, text, limit).withColumn("src", F.lit(0).cast("long"))
    if not changed:
        return found
    both = found.unionByName(find(rows, english, limit).withColumn("src", F.lit(1).cast("long")))
    all_ = Window.partitionBy()  # over two limits' rows at most
    both = both.withColumns({"full": F.max(~F.col("partial")).over(all_), "first": F.min("src").over(all_)})
    kept = both.where(F.when(F.col("full"), ~F.col("partial")).otherwise(F.col("src") == F.col("first")))
    once = kept.groupBy("id").agg(F.min(F.struct("src", "rank", "score", "partial")).alias("b")).select("id", "b.*")
    top = once.orderBy("src", "rank").limit(limit)
    return top.select("id", "score", (F.row_number().over(Window.orderBy("src", "rank")) - 1).cast("long").alias("rank"), "partial", "src")


def cutoff(top: Column) -> Column:
    return F.greatest(F.least(F.lit(FLOOR), top - NEAR), top - FAR)


def vector_top(rows: DataFrame, q: DataFrame, k: int, cut: bool = True) -> DataFrame:
    """The k rows most similar to the one query vector q(qvec), above the adaptive floor: id, score, floor."""
    top = rows.join(F.broadcast(q)).select("id", dot(F.col("vec"), F.col("qvec")).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    top = top.withColumn("floor", cutoff(F.max("score").over(Window.partitionBy())))  # over k rows at most
    return top.where(F.col("score") >= F.col("floor")) if cut else top


def hybrid(names: DataFrame, scores: DataFrame, ai: DataFrame, limit: int) -> DataFrame:
    """Strong name hits, then hits by listening, then weak name hits; each id once.

    names: id, rank; scores: id, score of every vector; ai: id, score, floor. A name hit is strong when it has no score or
    one that reaches the floor.
    """
    # One outer join uses each side once; a weak name hit can't be among the hits by listening, which reach the floor.
    met = names.select("id", "rank").join(ai.select("id", F.col("score").alias("heard"), "floor"), "id", "full_outer")
    met = met.withColumn("floor", F.coalesce(F.max("floor").over(Window.partitionBy()), F.lit(0.0)))  # over both limits' rows at most
    met = met.join(scores, "id", "left")
    named = F.col("rank").isNotNull()
    strong = F.col("score").isNull() | (F.col("score") >= F.col("floor"))
    first = met.select(
        "id", "score",
        F.when(named & strong, 1).when(F.col("heard").isNotNull(), 2).otherwise(3).alias("tier"),
        F.coalesce("rank", F.lit(0).cast("long")).alias("rank"),
        F.when(named, "name").otherwise("ai").alias("match"),
    )
    keys = ["tier", F.desc(F.coalesce("score", F.lit(-2.0))), "rank", "id"]
    top = first.orderBy(*keys).limit(limit)
    return top.select((F.row_number().over(Window.orderBy(*keys)) - 1).cast("long").alias("place"), "id", F.round("score", 6).alias("score"), "match")
