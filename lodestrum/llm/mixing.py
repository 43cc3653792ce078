"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: each source's share of all words follows its weight, up to `most` times its own size; what that cuts off is
shared out again by weight until no source is above. Each round is one aggregate over the table of sources; the driver
sees two sums a round.

Selection: a source is taken whole as often as its target allows, and the rest of the target is filled in the order of
exponential keys. A key is an exponential variate, drawn by hash, divided by the document's quality weight, so of two
documents the better one comes first as often as its weight says. The budget ends at one document of each source, which
two counts of words by ranges of the key and one sort inside a single range find, so no task ever holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrum.llm.common import SPACE, Store
from lodestrum.operators.catalog import ranked

WEIGHTS, MOST = (5, 2, 1), 3
#: Ranges of the key in either count: the first has RANGES / 16 for each unit, the second RANGES inside one of these.
RANGES = 1024
#: Hexadecimal digits of md5 that make a variate; as many as a double holds.
HEX = 13


def letters_share(text: Column) -> Column:
    """A quality weight of a text in (0, 1]: the share of letters among its visible characters, about."""
    own = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return (own(r"[^\p{L}]+") + 1) / (own(f"[{SPACE}]+") + 1)


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size and target of sources (source, source_size) in the order of their code points, null last; weights
    repeat in that order. The sum of all targets is that of all sizes."""
    order = ranked(sources.select(F.col("source").alias("id")), F.col("id").isNull(), F.col("id"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = order.select(F.col("id").alias("_s"), F.get(cycle, (F.col("rank") % len(weights)).cast("int")).alias("_w"))
    rows = sources.join(weighed, F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", F.col("_w").alias("w"), (F.col("source_size") * most).alias("cap"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises, and each round but the last cuts at least one source more
        above = F.col("cap") <= F.col("w") * level
        cut, open_ = rows.agg(F.sum(F.when(above, F.col("cap"))).alias("cut"), F.sum(F.when(~above, F.col("w"))).alias("open")).first()
        new = (total - (cut or 0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * level).alias("target"))


def _crossing(parts: DataFrame, at: str) -> DataFrame:
    """The part in which the words of a source's parts (source, left, n, at) in order exceed its `left`, with what is left there."""
    before = F.sum("n").over(Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    met = parts.withColumn("_rest", F.col("left") - F.coalesce(before, F.lit(0)))
    return met.where((F.col("_rest") >= 0) & (F.col("_rest") < F.col("n"))).withColumn("left", F.col("_rest")).drop("_rest", "n")


def mix(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    quality: Column | None = None,
    seed: int = 11,
    keep: Sequence[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) for every row of df; with `keep`, these columns
    of df in a struct `row` as well.

    A document is taken whole or not at all, up to `most` times. Where the next one in order would exceed the budget, the one
    from there on that comes nearest to what is left is taken, or none if that is nearer still; so a source misses its target
    by half of one document at most. quality is a positive weight, else letters_share of the text; null or less than 1e-6
    counts as 1e-6.

    A null text counts as the empty one: size 0, and taken with copies that give no words. A null source is one of its own,
    the last. A null id is drawn by its text. Rows that repeat id and text tie; which of them is taken at the end of a
    budget changes nothing that is returned but `row`. An empty table gives no rows, and if no row has words all targets are
    0. Texts of any length count whole. Columns of further names are ignored.
    """
    text, ident = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    draw = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.md5(text))
    variate = (F.conv(F.substring(F.md5(draw), 1, HEX), 16, 10).cast("long") + 0.5) / float(16**HEX)
    weight = F.greatest(F.coalesce((quality if quality is not None else letters_share(text)).cast("double"), F.lit(1e-6)), F.lit(1e-6))
    kept = [F.struct(*(F.col(c) for c in keep)).alias("row")] if keep else []
    rows = df.select(ident.alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"), (-F.log(variate) / weight).alias("key"), *kept)
    store = Store(df.sparkSession, "mixing")
    rows = store.put(rows.withColumn("at", F.monotonically_increasing_id()), "rows")  # texts are read once; `at` parts ties

    sizes = store.put(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    plan = targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int"))
    plan = store.put(plan.withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "targets")

    def of(found: DataFrame, *on: str) -> DataFrame:
        """The rows of what was found for their source (and ranges)."""
        own = found.select(*(F.col(c).alias(f"_{c}") for c in ("source", *on)), "left")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source", *on)]
        return ranged.join(own, same).drop(*(f"_{c}" for c in ("source", *on)))

    scaled = F.col("key") * (RANGES // 16)  # by powers of two, so that ranges follow the order of keys exactly
    wide = F.least(F.floor(scaled), F.lit(RANGES - 1))
    ranged = rows.where("size > 0").select("source", "size", "key", "at", wide.alias("wide"), F.least(F.floor((scaled - wide) * RANGES), F.lit(RANGES - 1)).alias("fine"))
    counted = lambda d, *by: d.groupBy("source", *by).agg(F.first("left").alias("left"), F.sum("size").alias("n"))
    first = _crossing(counted(of(plan), "wide"), "wide")
    second = _crossing(counted(of(first, "wide"), "wide", "fine"), "fine")
    # One range of the second count holds a 65,536th of a source, about, and its rows are sorted.
    inside = of(second, "wide", "fine").select("source", "left", F.col("size").alias("n"), F.struct("key", "at").alias("last"))
    end = store.put(_crossing(inside, "last"), "end")
    place = F.struct("key", "at")
    beyond = ranged.join(end.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).where(place >= F.col("last"))
    # The last place goes to the document from there on that comes nearest to what is left, if it comes nearer than none.
    final = beyond.groupBy("source").agg(F.first("last").alias("last"), F.first("left").alias("left"), F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "key", "at")).alias("best"))
    final = final.select(F.col("source").alias("_source"), "last", F.when(F.col("best.off") < F.col("left"), F.struct("best.key", "best.at")).alias("extra"))
    ends = store.put(plan.join(final, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "whole", "last", "extra"), "ends")

    partly = F.coalesce((place < F.col("last")) | F.coalesce(place == F.col("extra"), F.lit(False)), F.lit(False))
    met = rows.join(ends.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("whole") + partly.cast("int")
    return met.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if keep else []))


def mixed_rows(df: DataFrame, **how) -> DataFrame:
    """The rows of df as the mix takes them, each as often as it is taken; how: as for mix()."""
    taken = mix(df, keep=df.columns, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
