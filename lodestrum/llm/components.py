"""Connected components by alternating large-star and small-star steps, all of it in distributed joins.

An id may have any number of neighbours. Its edges are spread over SALTS places by the neighbour, so that no step needs
them together: each place finds its least neighbour, the places of an id find the least of all, and each edge meets the
answer at its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrum.llm.common import Store

SALTS = 256


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u."""
    edges = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    places = edges.groupBy("u", "s").agg(F.min("v").alias("least"))
    answers = places.select(F.col("u").alias("_u"), F.col("s").alias("_s"), F.min("least").over(Window.partitionBy("u")).alias("m"))  # SALTS rows of an id at most
    return edges.join(answers, (F.col("u") == F.col("_u")) & (F.col("s") == F.col("_s"))).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = _least(edges.union(edges.select("b", "a")).toDF("u", "v")).withColumn("m", F.least("u", "m"))
    return both.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = _least(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    # An edge to the least neighbour joins u itself to it, any other joins that neighbour.
    return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, store: Store | None = None) -> DataFrame:
    """(id, component): the least id reachable, for every id of edges (a, b). Edges of an id with itself don't matter.

    Each round is written to the shared folder and the one before it deleted. It ends when a round changes nothing, after
    about the logarithm of the longest path. Edges may repeat; no edges give no rows.
    """
    store = store or Store(edges.sparkSession, "components")
    edges, seen, last = edges.where("a <> b").select("a", "b").distinct(), None, None
    while True:
        edges = store.put(_small(_large(edges)).distinct(), "stars")
        if last is not None:
            store.drop(last)
        sign = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(edges.select("b").distinct().select("b", "b"))
        seen, last = sign, edges
