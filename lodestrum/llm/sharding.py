"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 60-bit hashes. A key belongs to the first point at or after its own
hash. Loads are bounded tightly: shard capacities differ by one row at most and add up to the row count. What a full
shard can't take continues clockwise to the next point whose shard has room. Only the row counts of the arcs between
points come to the driver, shards * vnodes numbers; the overflow is planned on them, and each row finds its shard by
its rank in its arc. Counts at most one apart are guaranteed; of the rows, those that overflow, and those that a new
shard takes, move when the ring grows.

An arc may hold any share of the rows, as where many repeat one id. Each task's rows are a strand of their arc; a row's
rank is its strand's first rank plus its place in the strand, so no task holds an arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrum.llm.common import Store, bounded_batches

SHARDS, VNODES = 40, 256
RING_HEX = 15  # hex digits of md5 that make a position
STRANDS = 1024  # into so many strands an arc's rows are dealt, by the task that read them


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes in order, and their shards."""
    points = sorted((int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:RING_HEX], 16), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int32)


def plan_arcs(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot) that place every row; at most arcs + shards + 1 of them for each walk."""
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    pieces, over = [], []

    def put(arc: int, start: int, shard: int, n: int) -> None:
        pieces.append((arc, start, start + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for arc, (n, shard) in enumerate(zip(counts.tolist(), owners.tolist(), strict=True)):
        home = min(n, room[shard])
        if home:
            put(arc, 0, shard, home)
        if n > home:
            over.append((arc, home, n - home))
    for arc, start, n in over:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            if take := min(n, room[int(owners[at])]):
                put(arc, start, int(owners[at]), take)
                start, n = start + take, n - take
    return pieces


def ring_shards(df: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: this law doesn't promise it) for every row.

    The size is 16 bytes more than the text in UTF-8; a null text has none. A null id is hashed with the text's checksum
    instead. Rows that repeat an id share an arc, and a shard as far as it has room. Rows of a strand tie by position, id,
    checksum and size; those that agree in all of them are interchangeable. An empty table gives no rows; texts of any
    length take part by size and checksum only; further columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    places, owners = ring(shards, vnodes)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strand = TaskContext.get().partitionId() % STRANDS
        for b in batches:
            at = np.searchsorted(places, b.column("pos").to_numpy(zero_copy_only=False))
            own = [pa.array((at % len(places)).astype(np.int32)), pa.array(np.full(b.num_rows, strand, np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "arc", "strand"])

    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    ident = F.col(id_col).cast("long")
    bytes_of = F.coalesce(F.octet_length(text_col), F.lit(0))
    key = F.when(ident.isNotNull(), ident.cast("string"))
    of_text = F.concat(F.lit("text:"), crc.cast("string"), F.lit(":"), bytes_of.cast("string"))
    pos = F.conv(F.substring(F.md5(F.coalesce(key, of_text)), 1, RING_HEX), 16, 10).cast("long")
    rows = df.select(ident.alias("doc_id"), (bytes_of + 16).cast("long").alias("size"), crc.alias("text_crc32"), pos.alias("pos"))
    # Written once, without texts: a row's strand must be the same wherever it's asked for.
    rows = Store(spark, "sharding").put(rows.mapInArrow(arcs, "doc_id long, size long, text_crc32 long, pos long, arc int, strand int"), "rows")

    counts = np.zeros(len(places), np.int64)
    for r in rows.groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    plan = spark.createDataFrame(plan_arcs(counts, owners, shards), "p_arc int, first_rank long, end_rank long, shard int, first_slot long")
    strands = rows.groupBy("arc", "strand").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("strand")) - F.col("n")  # STRANDS rows of an arc at most
    starts = strands.select(F.col("arc").alias("s_arc"), F.col("strand").alias("s_strand"), before.alias("start"))
    place = F.row_number().over(Window.partitionBy("arc", "strand").orderBy("pos", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("place", place).join(starts, (F.col("arc") == F.col("s_arc")) & (F.col("strand") == F.col("s_strand"))).withColumn("rank", F.col("start") + F.col("place"))
    met = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return met.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
