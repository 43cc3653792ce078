"""What the text operators share: table reading, Arrow limits, the shared folder and the labelled sample."""

from __future__ import annotations

import contextlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrum.session import ship

#: Bytes of one Arrow batch; a batch always holds one row at least.
BATCH_BYTES = 16 << 20
#: ASCII white space of the contracts, as the text of a regular expression class and as letters.
SPACE = r"\x20\x09-\x0D"
SPACE_LETTERS = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that very long texts don't meet in one batch; and the package on the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ship(spark)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, with an absent text as the empty one; other columns don't matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def decoded(column: pa.Array) -> list[str | None]:
    """Texts of a column. A string of Spark's may hold bytes that aren't UTF-8; the replacement character stands for them."""
    return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def file_bytes(path: str) -> bytes:
    """A vocabulary file as the driver sees it; its size doesn't grow with the data, so it goes out with the tasks."""
    return Path(path).read_bytes()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


# the shared folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; it goes when the session's process ends.

    Where the setting is absent, a local temporary folder will do for a local session, whose tasks are all on this
    machine; on a cluster there is none, and an error says so.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/lodestrum-shared"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, if it's there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_scopes: list[list[Store]] = []


class Store:
    """Tables that one call of an operator writes in the shared folder, so that later steps read files and not a long plan.

    A table goes when the operator drops it; what its result still reads goes with the scope around the call, or else
    when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, shared_folder(spark, name)
        self.tables: list[tuple[DataFrame, str]] = []
        if _scopes:
            _scopes[-1].append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{len(self.tables)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.spark._jvm.System.gc()  # plans of many steps leave garbage on the driver; collected now, its heap needn't grow
        self.tables.append((out, path))
        return out

    def add(self, df: DataFrame, name: str) -> None:
        """Write rows to a table that several steps fill; its rows are read by added()."""
        df.write.mode("append").parquet(f"{self.base}/{name}")

    def added(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        self.spark.createDataFrame([], schema).write.mode("append").parquet(path)  # so that there is a table
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that put() gave and that nothing reads any more."""
        for df, path in self.tables:
            if any(df is t for t in tables):
                remove(self.spark, path)

    def clear(self) -> None:
        remove(self.spark, self.base)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end all that operators called inside it have stored; their results must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for store in _scopes.pop():
            store.clear()


def numbered_rows(store: Store, df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, and that column's name. They are written, so that the numbers stay the same."""
    name = free_name(df, "_row")
    return store.put(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


# labelled rows


def label_counts(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the documents that have a label; one whose rows contradict each other has none."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return lab.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")


Sample = list[tuple[str, int]]
T = TypeVar("T")


def taught(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, rows: int, fit: Callable[[Sample, float], T]) -> T:
    """What fit makes of up to `rows` labelled texts outside the held-out fold, each whole, and of label 1's share of all
    labelled documents. It runs in one task, and only its result comes to the driver.

    A row is held out if crc32(doc_id as text) mod `fold` is `held`. Those of the least md5(doc_id) are drawn, half of each
    label where there are enough, so the choice doesn't depend on order or partitions. Of a document with several texts the
    first in the order of their bytes teaches. Rows without text, id or label teach nothing and are left out, as are documents
    with contradicting labels.
    """
    lab = label_counts(labels, label).where(F.crc32(F.col("doc_id").cast("string")) % fold != held)
    share = lab.agg(F.avg("y").alias("share")).first()["share"]
    share = 0.5 if share is None else share
    lab = lab.withColumn("h", F.md5(F.col("doc_id").cast("string")))
    pick = lab.where("y = 0").orderBy("h").limit(rows // 2).union(lab.where("y = 1").orderBy("h").limit(rows // 2))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    met = got.join(F.broadcast(pick), "doc_id").groupBy("h", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((h, t, y) for b in batches for h, t, y in zip(b.column("h").to_pylist(), decoded(b.column("text")), b.column("y").to_pylist(), strict=True))
        model = fit([(t, y) for _, t, y in found], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # Without rows there may be no task.
    made = met.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made is not None else fit([], share)
