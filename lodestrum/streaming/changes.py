"""Structured Streaming: change batches, late events, duplicates and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrum.operators.catalog import has_ignored_dir, is_audio

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Event files as they come, with event time in UTC."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def change_sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bursts of changes of a key, closed by a pause: started, n and the last kind."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return by.agg(F.count("*").alias("n"), F.max_by("event_type", "ts").alias("last_type")).select("user_id", F.col("s.start").alias("started"), "n", "last_type")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def without_repeats(events: DataFrame, late: str = "1 day", by: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One event of each key: in a stream the first to come, within the watermark; in a table the first by time and id."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(by))
    first = events.groupBy(*by).agg(F.min_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("_first"))
    return first.select("_first.*")


def running_stats(events: DataFrame) -> DataFrame:
    """Sums that later events add to and retractions (event_type 'retract') take from."""
    k = F.when(F.col("event_type") == "retract", -1).otherwise(1)
    return events.groupBy("user_id").agg(F.sum(k).alias("n"), F.sum(k * F.col("value")).alias("s1"), F.sum(k * F.col("value") * F.col("value")).alias("s2"))


def watch(spark: SparkSession, root: str, suppressed: DataFrame | None = None) -> DataFrame:
    """New files below a root as they come: path, name, size, mtime. Ignored folders and other kinds are left out, as are paths
    of `suppressed` (path, until): changes that the program has just made itself, until a time in ms. Contents aren't kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", name.alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    found = found.where(is_audio(F.col("name")) & ~has_ignored_dir(F.col("path")))
    if suppressed is None:
        return found
    quiet = suppressed.select(F.col("path").alias("_path"), "until")
    return found.join(quiet, (F.col("path") == F.col("_path")) & (F.col("mtime") <= F.col("until")), "left_anti")


#: Parts of a table of last changes, by the hash of the key: a batch rewrites only those that it touches.
PARTS = 64


class LastChanges:
    """A Parquet table of the last row of each key, in PARTS parts, each in versions: `target/v<epoch>/part=<n>`.

    A batch writes one folder with the parts it touches; a version counts once Spark has marked it complete, so a batch that
    is run again replaces its own output and nothing else. Versions of a part older than the one before are deleted.
    """

    def __init__(self, spark: SparkSession, target: str, schema: str, key: str, order: str) -> None:
        self.spark, self.target, self.schema, self.key, self.order = spark, target.rstrip("/"), schema, key, order
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.target).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self._fs.exists(self._path(path)) else []

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """Complete versions of each part, the oldest first."""
        epochs = sorted(int(n[1:]) for n in self._names(self.target) if n[:1] == "v" and n[1:].isdigit())
        out: dict[int, list[int]] = {}
        for e in epochs:
            inside = self._names(f"{self.target}/v{e}") if before is None or e < before else []
            for n in inside if "_SUCCESS" in inside else []:
                if n.startswith("part="):
                    out.setdefault(int(n[5:]), []).append(e)
        return out

    def read(self, before: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """The table, as it was before a batch, or some of its parts."""
        paths = [f"{self.target}/v{es[-1]}/part={p}" for p, es in self.versions(before).items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """A foreachBatch function."""
        part = F.pmod(F.xxhash64(self.key), F.lit(PARTS))
        rest = [c for c in batch.columns if c != self.key]
        newest = lambda d: d.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.order).alias("b")).select(self.key, "b.*")
        news = newest(batch)
        touched = {r["p"] for r in news.select(part.alias("p")).distinct().collect()}  # PARTS at most
        both = newest(self.read(epoch, touched).unionByName(news)) if touched else news
        both.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.target}/v{epoch}")
        for p, es in self.versions().items():
            for old in es[:-2]:
                self._fs.delete(self._path(f"{self.target}/v{old}/part={p}"), True)
