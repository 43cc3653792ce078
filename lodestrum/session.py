"""Session settings for the library; a cluster's own settings win over these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("lodestrum")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()


def shared(spark: SparkSession) -> str:
    """A folder below the one that spark.checkpoint.dir names, which the driver and all executors share. A local session without
    the setting gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="lodestrum-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that what follows starts from files and not from a long plan, and a lost
    executor costs none of it."""
    shared(df.sparkSession)
    return df.checkpoint()


#: What a task reads of a shuffle when Spark puts partitions together. Keys that compress well make 5 million rows of Spark's own
#: 64 MB, which a join sorts in memory on both sides.
READ = "16m"


def narrow(spark: SparkSession) -> None:
    """Tasks after a shuffle read READ, unless the cluster's own settings say how much."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, READ)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each context, unless it already came in an archive."""
    import shutil
    import tempfile
    from pathlib import Path

    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_lodestrum_shipped", False) or not home.is_dir():
        return
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/lodestrum_package", "zip", home.parent, home.name))
    sc._lodestrum_shipped = True
