"""Tables, and the catalogue entities that the queries see in them.

Every adapter has its SQL in CTES, so that a query's SQL can start from the same entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.session import narrow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's files: id, name, dir, top_level, size, mtime, path."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".wav")).alias("name"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("dir"),
        F.col("p_brand").alias("top_level"),
        F.col("p_size").cast("long").alias("size"),
        (F.col("p_partkey") * 1000).alias("mtime"),
    ).withColumn("path", F.concat("dir", F.lit("/"), "name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors with double elements: id, vec, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A former and a present listing (path, size, mtime): some files gone, some new, some touched, some renamed, some spelled
    in other letters."""
    e = entries(spark, sf_dir)
    before = e.where("id % 7 <> 0").select("path", "size", "mtime")
    now = e.where("id % 11 <> 0").select(
        F.when(F.expr("id % 17 = 0"), F.concat("dir", F.lit("/moved "), "name")).when(F.expr("id % 23 = 0"), F.concat("dir", F.lit("/"), F.upper("name"))).otherwise(F.col("path")).alias("path"),
        "size",
        F.expr("case when id % 13 = 0 then mtime + 1 else mtime end").alias("mtime"),
    )
    return before, now


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each user: series, i, x."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).cast("long").alias("i"), ((F.col("value") - 20) / 100).alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature frames for each user: series, w, f0 to f3."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("series"),
        (F.row_number().over(w) - 1).cast("long").alias("w"),
        F.col("value").alias("f0"),
        F.get_json_object("props", "$.k").cast("double").alias("f1"),
        (F.col("event_type") == "click").cast("double").alias("f2"),
        (F.col("event_type") == "view").cast("double").alias("f3"),
    )


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vaults with collections of paths: vault, collection, pos, path. The files are merged: by the size of their table's files
    they would be broadcast, which in memory is a hundred times that and grows with the listing."""
    narrow(spark)
    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = entries(spark, sf_dir).select("id", "path").hint("merge")
    lines = item.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(e, F.col("l_partkey") == F.col("id"), "left").select(
        F.col("o_custkey").alias("vault"),
        F.col("o_orderkey").alias("collection"),
        F.col("l_linenumber").cast("long").alias("pos"),
        F.coalesce("path", F.concat(F.lit("missing/"), F.col("l_partkey").cast("string"))).alias("path"),
    )


CTES = {
    "entries": """entries as (select *, dir || '/' || name as path from (
  select p_partkey as id, p_name || ' ' || lpad(p_partkey::varchar, 6, '0') || '.wav' as name, p_brand || '/' || p_type as dir,
         p_brand as top_level, p_size::bigint as size, p_partkey * 1000 as mtime from part))""",
    "vectors": "vectors as (select vec_id as id, embedding::double[] as vec, label::bigint as label from embeddings)",
    "snapshots": """before as (select path, size, mtime from entries where id % 7 <> 0),
now_ as (select case when id % 17 = 0 then dir || '/moved ' || name when id % 23 = 0 then dir || '/' || upper(name) else path end as path, size,
               case when id % 13 = 0 then mtime + 1 else mtime end as mtime from entries where id % 11 <> 0)""",
    "samples": """samples as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as i, (value - 20) / 100 as x from events)""",
    "frames": """frames as (select user_id as series, row_number() over (partition by user_id order by ts, event_id) - 1 as w, value as f0,
  json_extract_string(props, '$.k')::double as f1, (event_type = 'click')::int::double as f2, (event_type = 'view')::int::double as f3 from events)""",
    "shelves": """shelves as (select o_custkey as vault, o_orderkey as collection, l_linenumber::bigint as pos, coalesce(path, 'missing/' || l_partkey::varchar) as path
  from lineitem join orders on l_orderkey = o_orderkey left join entries on l_partkey = id)""",
}


def sql(names: str, body: str, *more: str) -> str:
    """A query text over the named entities and further common tables."""
    return "with " + ",\n".join([*(CTES[n] for n in names.split()), *more]) + "\n" + body
