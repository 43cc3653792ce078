"""A stored index of vectors: lists of two levels, whose number grows with the rows, in files that a search prunes.

The upper centres are fitted on a sample of a fixed size, as InvertedLists does. Each upper list is cut into lower ones, about
a quarter of the root of its rows, fitted on a sample that grows alike; so a lower list holds about four times that root, and a
billion rows make some 75,000 lists. Files are cut into directories by the upper list and sorted by the lower one, `list`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrum.operators.generations import Generations
from lodestrum.operators.similar import BLOCK, InvertedLists, _matrix, in_blocks, knn, ranked_pairs, unit_means

#: Lower lists an upper one can have: `list` is top * SPAN + the place of the lower list.
SPAN = 1 << 20
#: More than any list's number, as there are 90 upper lists at most.
LISTS = 1 << 27
#: Sampled rows for each lower centre, and Lloyd's steps.
TAUGHT, STEPS = 16, 8
#: Lists that a search names to the scan; where its queries ask for more, it reads all lists and joins.
NAMED = 4096


class StoredLists(Generations):
    """Rows: id, vec (unit vectors without nulls); other columns are left alone, ids are taken to be distinct. Equal vectors are
    all in one list, however many there are: it is stored in many files and compared in blocks. An empty table gives an index
    without hits, whose centres are fitted on the first rows put later."""

    TABLES = {"lists": "id long, vec array<double>, list long, top int", "centres": "list long, vec array<double>, top int"}

    @classmethod
    def create(cls, rows: DataFrame, path: str, k: int = 10, target: float = 0.99, asked: int = 256) -> StoredLists:
        """Fits centres, stores every row in its list, and measures on `asked` rows how many lists a search must read to find
        `target` of their k true neighbours, which are found by comparing with all rows."""
        index = cls._new(rows.sparkSession, path, 0)
        index._begin(rows.select(F.col("id").cast("long").alias("id"), "vec"), 0, k, target, asked)
        index._done(0, rows, None)
        return index

    def _begin(self, rows: DataFrame, gen: int, k: int, target: float, asked: int) -> None:
        """Centres, the first rows and the number of lists to read, which stays 0 while there are no rows."""
        if rows.isEmpty():
            self.spark.createDataFrame([], self.TABLES["lists"]).write.mode("overwrite").partitionBy("top").parquet(f"{self.path}/lists/g{gen}")
            return
        upper = InvertedLists(rows, k)
        dealt = upper.nearest_lists(rows, "id", "vec", 1).withColumnRenamed("list", "top")
        self._fit(dealt, upper.centres)
        self._store(dealt, gen)
        self.setting = self._lists_needed(rows, gen, k, target, asked)

    def _fit(self, dealt: DataFrame, upper: np.ndarray) -> None:
        sizes = dealt.groupBy(F.col("top").alias("_top")).agg(F.ceil(F.sqrt(F.count("*")) / 4).cast("int").alias("subs"), F.count("*").alias("n"))
        # One row for each upper centre, of which there are 90 at most.
        drawn = dealt.join(F.broadcast(sizes), F.col("top") == F.col("_top"))
        drawn = drawn.where(F.pmod(F.xxhash64("id", F.lit("taught")), F.lit(1 << 30)) * F.col("n") < F.lit(float(1 << 30)) * TAUGHT * F.col("subs"))

        def fitted(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            top, v = t.column("top")[0].as_py(), _matrix(t.column("vec"))
            c = np.unique(unit_means(v, t.column("subs")[0].as_py(), STEPS, np.random.default_rng(top)), axis=0)
            return pa.table({"list": pa.array(top * SPAN + np.arange(len(c)), pa.int64()), "vec": pa.array(c.tolist(), pa.list_(pa.float64())), "top": pa.array([top] * len(c), pa.int32())})

        lower = drawn.select("id", "vec", "top", "subs").groupBy("top").applyInArrow(fitted, self.TABLES["centres"])
        # An upper list that no row of the sample is in keeps its own centre.
        own = self.spark.createDataFrame([(t, t * SPAN, c.tolist()) for t, c in enumerate(upper)], "_top int, _list long, _vec array<double>")
        every = lower.join(F.broadcast(own), F.col("top") == F.col("_top"), "right")
        every = every.select(F.coalesce("list", "_list").alias("list"), F.coalesce("vec", "_vec").alias("vec"), F.coalesce("top", "_top").alias("top"))
        every.write.mode("overwrite").parquet(f"{self.path}/centres/g0")
        self.spark.createDataFrame([(t, c.tolist()) for t, c in enumerate(upper)], "top int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/upper")

    def _store(self, dealt: DataFrame, gen: int) -> None:
        """Rows (id, vec, top) beside the centres of their upper list, in blocks, so that no task holds a whole list."""
        sizes = dealt.groupBy(F.col("top").alias("_top")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # 90 rows at most
        joined = lambda d: d.join(F.broadcast(sizes), F.col("top") == F.col("_top"))
        left = joined(dealt).select("id", "vec", F.col("top").cast("int").alias("top"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        right = joined(self._read("centres", 0)).select("list", F.col("vec").alias("centre"), F.col("top").alias("c_top"), blocks.alias("c_block"))

        def placed(rows: pa.Table, centres: pa.Table) -> pa.Table:
            centres = centres.sort_by("list")
            own = (_matrix(rows.column("vec")) @ _matrix(centres.column("centre")).T).argmax(1) if len(rows) else np.zeros(0, int)
            lists = centres.column("list").to_numpy()[own]
            return pa.table({"id": rows.column("id"), "vec": rows.column("vec"), "list": pa.array(lists, pa.int64()), "top": pa.array(lists // SPAN, pa.int32())})

        found = left.groupBy("top", "block").cogroup(right.groupBy("c_top", "c_block")).applyInArrow(placed, self.TABLES["lists"])
        found.sortWithinPartitions("top", "list", "id").write.mode("overwrite").partitionBy("top").parquet(f"{self.path}/lists/g{gen}")

    def put(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """A generation with these rows, in place of what the index has of their ids, and without those removed (id). Centres stay;
        where what is added is unlike what they were fitted on, make the index anew."""
        gen, news = self._next(), rows.select(F.col("id").cast("long").alias("id"), "vec")
        if not self.setting:
            self._begin(news, gen, 10, 0.99, 256)
        else:
            upper = InvertedLists.__new__(InvertedLists)
            upper.centres = _matrix(self.spark.read.parquet(f"{self.path}/upper").orderBy("top").toArrow().column("vec"))
            self._store(upper.nearest_lists(news, "id", "vec", 1).withColumnRenamed("list", "top"), gen)
        return self._done(gen, rows, removed)

    def _lists_needed(self, rows: DataFrame, gen: int, k: int, target: float, asked: int) -> int:
        queries = rows.orderBy(F.xxhash64("id", F.lit("asked")), "id").limit(asked)
        held = queries.toArrow()  # `asked` rows
        if not len(held):
            return 1
        true = knn(queries, rows, k).select("qid", "id")
        lists = self._read("lists", gen).join(F.broadcast(true), "id").select("qid", "list").toArrow()  # asked * k rows
        qids, matrix = held.column("id").to_numpy(), _matrix(held.column("vec"))
        row = {q: i for i, q in enumerate(qids)}
        at, wanted = np.array([row[q] for q in lists.column("qid").to_numpy()], int), lists.column("list").to_numpy()
        if not len(at):
            return 1
        centres = self._read("centres", 0)
        own = {r["list"]: np.array(r["vec"]) for r in centres.where(F.col("list").isin(np.unique(wanted).tolist())).collect()}
        need = np.array([matrix[i] @ own[x] for i, x in zip(at, wanted)])
        shared = self.spark.sparkContext.broadcast((matrix, at, need))

        def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, at, need = shared.value
            n = np.zeros(len(at), np.int64)
            for b in batches:
                if b.num_rows:
                    n += ((matrix @ _matrix(b.column("vec")).T)[at] > need[:, None] + 1e-12).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at)), pa.int64()), pa.array(n)], ["j", "n"])

        counts = centres.select("vec").mapInArrow(closer, "j long, n long").groupBy("j").agg(F.sum("n").alias("n")).toArrow()
        places = np.sort(counts.column("n").to_numpy()) + 1
        return int(places[int(np.ceil(target * len(places))) - 1])

    def lists_of(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """The lists nearest to each query (id, vec): qid, list."""
        low, high = queries.agg(F.min("id"), F.max("id")).first()
        if low is None or not self.setting:
            return self.spark.createDataFrame([], "qid long, list long")
        # Lists get numbers beyond all ids of queries, as knn() takes an equal id for the query itself. Of equally near centres
        # the first comes first, as in the storing of rows.
        base = low - LISTS if low - LISTS >= -(1 << 63) else high + 1
        centres = self._read("centres", 0).select((F.col("list") + F.lit(base)).alias("id"), "vec")
        return knn(queries, centres, probes or self.setting).select("qid", (F.col("id") - F.lit(base)).alias("list"))

    def asked(self, lists: DataFrame) -> DataFrame:
        """The stored rows of these lists (list): directories and sorted lists are tested by the scan itself."""
        rows = self._every("lists")
        named = [r["list"] for r in lists.select("list").distinct().limit(NAMED + 1).collect()]
        if len(named) > NAMED:
            return rows
        return rows.where(F.col("top").isin(sorted({x // SPAN for x in named})) & F.col("list").isin(sorted(named)))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """qid, id, score and rank of up to k neighbours of each query (id, vec), an id not being its own neighbour."""
        near = self.lists_of(queries, probes)
        q = queries.select(F.col("id").cast("long").alias("qid"), F.col("vec").alias("qvec")).join(near, "qid")
        rows = self._live(self.asked(near)).select("id", "vec", "list")
        return ranked_pairs(in_blocks(q, rows, k), k)
