"""What stored indexes share: generations of rows, of which later ones replace or remove the ids of earlier ones.

Folder of an index, all Parquet: `<table>/g<n>` holds the rows of generation n, `gone/g<n>` the ids that it replaces or removes,
and `made` a row for each whole generation. A generation counts from the moment its row is there, so a writer that is lost leaves
the index as it was, and the next one writes over what it left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Generations:
    #: The schema of each table, by name.
    TABLES: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str) -> None:
        """An index that exists; create() of each kind makes one."""
        self.spark, self.path = spark, path.rstrip("/")
        made = spark.read.parquet(f"{self.path}/made").collect()  # one small row a generation
        self.generations = sorted({r["gen"] for r in made})
        #: A number that the kind of index keeps for itself.
        self.setting = max(made, key=lambda r: r["gen"])["setting"]

    @classmethod
    def _new(cls, spark: SparkSession, path: str, setting: int):
        index = cls.__new__(cls)
        index.spark, index.path, index.generations, index.setting = spark, path.rstrip("/"), [], setting
        return index

    def _next(self) -> int:
        return self.generations[-1] + 1 if self.generations else 0

    def _done(self, gen: int, rows: DataFrame, removed: DataFrame | None) -> int:
        """The last step of a generation: what it replaces, then its row in `made`."""
        ids = lambda d: d.select(F.col("id").cast("long").alias("id"))
        gone = ids(rows) if removed is None else ids(rows).union(ids(removed))
        gone.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/g{gen}")
        self.spark.createDataFrame([(gen, self.setting)], "gen int, setting int").coalesce(1).write.mode("append").parquet(f"{self.path}/made")
        self.generations.append(gen)
        return gen

    def _read(self, table: str, gen: int) -> DataFrame:
        return self.spark.read.schema("id long" if table == "gone" else self.TABLES[table]).parquet(f"{self.path}/{table}/g{gen}")

    def _every(self, table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read(table, g).withColumn("gen", F.lit(g)) for g in self.generations])

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, gen) that no later generation replaces."""
        if len(self.generations) < 2:
            return rows
        gone = self._every("gone").where(F.col("gen") > self.generations[0]).groupBy(F.col("id").alias("_id")).agg(F.max("gen").alias("_gen"))
        return rows.join(gone, F.col("id") == F.col("_id"), "left").where(F.col("_gen").isNull() | (F.col("_gen") <= F.col("gen"))).drop("_id", "_gen")
