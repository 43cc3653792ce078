"""Vaults (id, name, color, active): made, switched, changed, deleted and duplicated. One of them is active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The colour of a vault that has no valid one, what a valid one is, and the longest name.
DEFAULT_COLOR, COLOR, NAME = "#c8f76d", "^#[0-9a-fA-F]{6}$", 80


def created(vaults: DataFrame, news: DataFrame) -> DataFrame:
    """With further ones (id, name, color), which aren't active."""
    name = F.trim(F.coalesce("name", F.lit("")))
    color = F.when(F.col("color").rlike(COLOR), F.col("color")).otherwise(DEFAULT_COLOR)
    return vaults.unionByName(news.select("id", F.when(name == "", "New Vault").otherwise(name).alias("name"), color.alias("color"), F.lit(False).alias("active")))


def switched(vaults: DataFrame, to: DataFrame) -> DataFrame:
    """With another one active (one row: id); an id that isn't there changes nothing."""
    known = to.join(vaults.select("id"), "id", "left_semi").agg(F.max("id").alias("_to"))  # one row, null if unknown
    return vaults.join(F.broadcast(known)).withColumn("active", F.coalesce(F.col("id") == F.col("_to"), F.col("active"))).drop("_to")


def updated(vaults: DataFrame, patches: DataFrame) -> DataFrame:
    """With new names and colours (id, name, color) where they are valid: a name that isn't blank, trimmed and cut, and a colour
    in hex."""
    p = patches.select("id", F.trim("name").alias("_name"), F.col("color").alias("_color"))
    name = F.when(F.coalesce(F.col("_name"), F.lit("")) != "", F.substring("_name", 1, NAME)).otherwise(F.col("name"))
    color = F.when(F.coalesce(F.col("_color").rlike(COLOR), F.lit(False)), F.col("_color")).otherwise(F.col("color"))
    return vaults.join(p, "id", "left").withColumns({"name": name, "color": color}).select(*vaults.columns)


def deleted(vaults: DataFrame, gone: DataFrame) -> DataFrame:
    """Without some (id); the last one can't be deleted, so if all would go the first stays. If the active one goes, the first
    that is left becomes active."""
    left = vaults.join(gone.select("id"), "id", "left_anti")
    first = vaults.agg(F.min("id").alias("_first"))
    some = left.agg(F.min("id").alias("_left"), F.coalesce(F.bool_or("active"), F.lit(False)).alias("_has"))
    one = vaults.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left").join(F.broadcast(first)).join(F.broadcast(some))  # single rows
    kept = one.where(F.col("_gone").isNull() | (F.col("_left").isNull() & (F.col("id") == F.col("_first"))))
    return kept.withColumn("active", F.when(F.col("_has"), F.col("active")).otherwise(F.col("id") == F.coalesce("_left", "_first"))).select(*vaults.columns)


def duplicated(vaults: DataFrame, copies: DataFrame) -> DataFrame:
    """With copies (id, new_id), named as such."""
    own = vaults.join(copies, "id").withColumns({"id": F.col("new_id"), "name": F.concat("name", F.lit(" (copy)")), "active": F.lit(False)})
    return vaults.unionByName(own.select(*vaults.columns))
