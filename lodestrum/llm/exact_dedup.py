"""Exact deduplication by skew-safe combining.

Three combining steps, each comparing whole contents and not only digests:

1. local: a task groups the rows it reads and sends one representative with the ids of its copies;
2. salted: representatives of a digest meet by (digest, salt). The salt tells which task sent them, so a group of any
   size is spread over `salts` tasks, whatever its ids;
3. global: the winners of the salts, at most `salts` for each group, meet by digest.

Only representatives carry text through a shuffle. Copies carry their id, whatever the size of the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrum.llm.common import SPACE_LETTERS, bounded_batches, free_name, texts

#: The characters that normalisation deletes; all are single bytes in UTF-8.
SPACE_BYTES = SPACE_LETTERS.encode()
SALTS = 256
#: A task sends its groups on when they hold so many bytes or rows; groups cut apart so meet again in the salted step.
LOCAL_BYTES, LOCAL_ROWS = 48 << 20, 100_000
#: The same where whole rows travel, which a task holds in several forms at a time.
ROW_BYTES = 12 << 20
LOCAL_SCHEMA = "digest binary, salt int, rep_id long, rep_points long, norm binary, members array<long>"


def sha256(norm: bytes) -> bytes:
    return hashlib.sha256(norm).digest()


def _before(points: int, doc_id: int | None, group: list) -> bool:
    """Does a row stay rather than the group's present representative? More code points, then the smaller id; no id comes last."""
    if points != group[1]:
        return points > group[1]
    return doc_id is not None and (group[2] is None or doc_id < group[2])


def _salts(salts: int) -> Iterator[int]:
    """The salts of what this task sends, one after the other: by its number, so that a task run again gives the same."""
    at = TaskContext.get().partitionId()
    while True:
        yield at % salts
        at += 7919


def _local(digest: Callable[[bytes], bytes], salts: int, most_bytes: int, most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(found: dict[bytes, list[list]], salt: int) -> pa.RecordBatch:
        rows = [(d, salt, g[2], g[1], g[0], g[3]) for d, groups in found.items() for g in groups]
        types = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["digest", "salt", "rep_id", "rep_points", "norm", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[list]] = {}  # digest: [content, points, id, members with the representative first]
        held = rows = 0
        salt = _salts(salts)
        for batch in batches:
            points = pc.utf8_length(batch.column(1)).to_pylist()
            for doc_id, text, n in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), points, strict=True):
                norm = text.translate(None, SPACE_BYTES)
                groups = found.setdefault(digest(norm), [])
                group = next((g for g in groups if g[0] == norm), None)
                rows += 1
                if group is None:
                    groups.append([norm, n, doc_id, [doc_id]])
                    held += len(norm)
                elif _before(n, doc_id, group):
                    group[1], group[2] = n, doc_id
                    group[3].append(group[3][0])
                    group[3][0] = doc_id
                else:
                    group[3].append(doc_id)
                if held >= most_bytes or rows >= most_rows:
                    yield send(found, next(salt))
                    found, held, rows = {}, 0, 0
        if found:
            yield send(found, next(salt))

    return run


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS, digest: Callable[[bytes], bytes] = sha256, local_bytes: int = LOCAL_BYTES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (the digest in hex).

    Texts are equal when they are so without ASCII white space. A null text is an empty one, so null, empty and blank
    texts form one group. Of a group the row with the most code points stays, then the one with the smallest id; a null
    id comes last. Of rows that repeat both, exactly one stays. Texts of any length are compared whole. An empty table gives no
    rows; other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    reps = texts(df, id_col, text_col).mapInArrow(_local(digest, salts, local_bytes, local_rows), LOCAL_SCHEMA)
    best = [F.desc("rep_points"), F.asc_nulls_last("rep_id")]
    group = Window.partitionBy("digest", "salt", "norm")
    # Dealt once for all windows below, in both uses of the salted step: the filter, which no row fails, is one that the join
    # asks of one use only, and would make another shuffle of it.
    dealt = reps.where("digest is not null and salt is not null").repartition("digest", "salt")
    salted = dealt.select(
        "digest", "salt", "norm", "rep_points", "rep_id", "members",
        F.row_number().over(group.orderBy(*best)).alias("place"),
        F.sum(F.size("members").cast("long")).over(group).alias("salt_size"),
    )
    # Contents of one digest and salt are told apart by a number from here on, so that text goes no further than it must.
    salted = salted.withColumn("content", F.dense_rank().over(Window.partitionBy("digest", "salt").orderBy("norm")))
    whole = Window.partitionBy("digest", "norm")
    first = whole.orderBy(*best, "salt")
    winners = salted.where("place = 1 and size(members) > 0").select(
        F.col("digest").alias("w_digest"), F.col("salt").alias("w_salt"), F.col("content").alias("w_content"),
        F.first("rep_id").over(first).alias("keep_id"), F.first("salt").over(first).alias("keep_salt"),
        F.sum("salt_size").over(whole).alias("group_size"),
    )
    rows = salted.select("digest", "salt", "content", "place", "members", "rep_points", "rep_id", "salt_size")
    same = (F.col("digest") == F.col("w_digest")) & (F.col("salt") == F.col("w_salt")) & (F.col("content") == F.col("w_content")) & (F.col("salt_size") <= F.col("group_size"))
    met = rows.join(winners, same)
    kept = (F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))
    return met.select("digest", "keep_id", "group_size", kept.alias("first"), F.posexplode("members").alias("pos", "doc_id")).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("pos") == 0) & F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _best_rows(id_at: str, text_at: str, digest_at: str, salt_at: str, salts: int, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of what a task reads, so many bytes at a time: the best row of each content, whole, with digest and salt."""

    def best(held: list[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        ids, column = rows.column(id_at).cast(pa.int64()).to_pylist(), pc.coalesce(rows.column(text_at), "")
        found: dict[bytes, tuple] = {}  # a content's (points, id, row)
        for k, (text, n, doc_id) in enumerate(zip(column.cast(pa.binary()).to_pylist(), pc.utf8_length(column).to_pylist(), ids, strict=True)):
            norm = text.translate(None, SPACE_BYTES)
            if (last := found.get(norm)) is None or _before(n, doc_id, [norm, *last]):
                found[norm] = (n, doc_id, k)
        taken = rows.take(pa.array([k for _, _, k in found.values()], pa.int64()))
        taken = taken.append_column(digest_at, pa.array([sha256(norm) for norm in found], pa.binary())).append_column(salt_at, pa.array([salt] * len(found), pa.int32()))
        yield from taken.to_batches(max_chunksize=2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, salt = [], 0, _salts(salts)
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= most_bytes:
                rows, held, size = held, [], 0
                yield from best(rows, next(salt))
        if held:
            yield from best(held, next(salt))

    return run


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = SALTS, local_bytes: int = ROW_BYTES) -> DataFrame:
    """The rows of df that stay, with all their columns: exactly one of a group, by the rule of exact_groups.

    The three steps are those of exact_groups, but the rows themselves travel, so that none has to be found again and ids
    may repeat or be null: the best row of a task, then of a salt, then of all, so what a task compares of one group is at
    most what a salt's tasks have sent, and then a row for each salt. Of rows that tie in both length and id, one stays.
    """
    bounded_batches(df.sparkSession)
    digest, salt = free_name(df, "_digest"), free_name(df, "_salt")
    local = df.mapInArrow(_best_rows(id_col, text_col, digest, salt, salts, local_bytes), df.withColumns({digest: F.lit(b""), salt: F.lit(0)}).schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.desc(F.length(text)), F.asc_nulls_last(F.col(id_col).cast("long"))]

    def winners(rows: DataFrame, *by: str) -> DataFrame:
        content = Window.partitionBy(*by, F.translate(text, SPACE_LETTERS, "")).orderBy(*order)
        before = free_name(rows, "_before")  # null in a content's first row; unlike a rank, it isn't looked for before the shuffle too
        return rows.withColumn(before, F.lag(F.lit(1)).over(content)).where(F.col(before).isNull()).drop(before)

    for by in ((digest, salt), (digest,)):
        local = winners(local, *by)
    return local.drop(digest, salt)
