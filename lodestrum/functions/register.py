"""The text functions for SQL, as SQL functions of the session: bodies are expressions, so they run in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestrum.functions.text import FOLD_FROM, FOLD_TO


def register(spark: SparkSession) -> list[str]:
    """Makes fold_text, tokens_of, cutoff_of and the table function words_of; gives their names."""
    fold = f"translate(x, '{FOLD_FROM}', '{FOLD_TO}')"
    tokens = r"filter(split(fold_text(lower(x)), r'[^\p{L}\p{N}]+'), t -> t <> '')"
    spark.sql(f"create or replace temporary function fold_text(x string) returns string return {fold}")
    spark.sql(f"create or replace temporary function tokens_of(x string) returns array<string> return {tokens}")
    spark.sql("create or replace temporary function cutoff_of(top double) returns double return greatest(least(0.30D, top - 0.05D), top - 0.25D)")
    spark.sql("create or replace temporary function words_of(x string) returns table(pos int, word string) return select pos, word from (select posexplode(t) as (pos, word) from (select tokens_of(x) as t))")
    return ["fold_text", "tokens_of", "cutoff_of", "words_of"]
