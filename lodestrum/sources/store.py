"""A table kept as numbered versions: a version counts once Spark has marked it complete, so a lost writer leaves the
last one in place. Old versions beyond the last two are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestrum.operators.changes import upsert


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self._fs.exists(self._path(self.path)))

    def versions(self) -> list[int]:
        """Complete versions, the oldest first."""
        if not self.exists():
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [v for v in found if self._fs.exists(self._path(f"{self.path}/v{v}/_SUCCESS"))]

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or a given one; an empty table if there is none. Columns added since come as nulls."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{have[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """A new version, also of a table made from an older version of this one."""
        have = self.versions()
        n = have[-1] + 1 if have else 0
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v{n}")
        for old in have[:-1]:
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)
        return n

    def merge(self, news: DataFrame, key: str, keep: list[str]) -> int:
        """A new version with rows of news put in by key; a null in a column of keep leaves the old value."""
        from pyspark.sql import functions as F

        return self.write(upsert(self.read(), news.withColumn("_new", F.lit(True)), key, keep))
