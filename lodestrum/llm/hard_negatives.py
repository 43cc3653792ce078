"""Mining hard negatives by bit-sliced integer products.

Vectors are whole numbers. A candidate's components are cut into planes of bits, the most significant first; after each
plane the score of a pair is known up to an interval, as the bits still missing can add no more than all of them set where
the anchor is positive, and no less than all of them set where it is negative. A pair whose interval can't reach what the
anchor already holds, or leaves the span asked for, is dropped. The first planes are products of matrices; once few pairs
are left, only these are taken through the rest.

Anchors meet the rows in blocks of about BLOCK, which are broadcast: a pass over the rows, without a shuffle of vectors,
finds each anchor's positives, a second one the negatives that lie in their spans. A task sends no more than the first few
of each list, whatever the sizes of labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrum.llm.common import Store, bounded_batches
from lodestrum.llm.whitening import matrix

SCALE = 256
#: Components are whole numbers of at most this size, so that no product of up to 512 of them leaves a long.
LARGEST = 2.0**26
#: Anchors that one pass takes, about; they are the only thing that is broadcast.
BLOCK = 2048
#: Anchors that meet a batch of rows at a time.
TILE = 128
#: Below this share of pairs left, planes are taken pair by pair.
SPARSE = 0.05
#: What sorts after every id: rows without one come last.
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def scaled(vec: Column) -> Column:
    """The vector in whole numbers, null where it has none, a null entry or one that isn't finite."""
    sound = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(sound & (F.size(vec) > 0), F.transform(vec, lambda c: entry(c).cast("int")))


class Planes:
    """The bits of whole vectors, from `bits` down to 0, of the vectors plus 2 ** bits, which are none below 0."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.bits = max(1, int(max(vectors.max(initial=0), -vectors.min(initial=0))).bit_length())
        self.raw = vectors + (1 << self.bits)

    def plane(self, bit: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (self.raw[rows] >> bit) & 1


@dataclass
class Spans:
    """Lists asked for: for each anchor a row with a place for each of its lists. A list wants the k best scores from low to
    high; floor is what a score must reach to enter it, as far as is known. A place with low above high is no list."""

    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    k: int

    def narrowed(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
        """Which pairs can still enter a list, if their scores lie between low and high. Pairs are a matrix of anchors and rows,
        or else single ones of the anchors a. What is certain to lie within a list raises its floor."""
        own = (lambda v: v[:, None]) if a is None else (lambda v: v[a])
        can = np.zeros(low.shape, bool)
        for p in range(self.low.shape[1]):
            certain = alive & (low >= own(self.low[:, p])) & (high <= own(self.high[:, p]))
            best = _kth_of_rows(np.where(certain, low, LEAST), self.k) if a is None else _kth_of_groups(a[certain], low[certain], self.k, len(self.low))
            self.floor[:, p] = np.maximum(self.floor[:, p], best)
            can |= (high >= own(self.floor[:, p])) & (low <= own(self.high[:, p]))
        return alive & can


def _kth_of_rows(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), LEAST)


def _runs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and its length."""
    starts = np.nonzero(np.r_[True, np.diff(groups) != 0])[0] if len(groups) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(groups)])


def _kth_of_groups(groups: np.ndarray, values: np.ndarray, k: int, n: int) -> np.ndarray:
    out, order = np.full(n, LEAST), np.lexsort((-values, groups))
    starts, sizes = _runs(groups[order])
    full = starts[sizes >= k]
    out[groups[order[full]]] = values[order[full + k - 1]]
    return out


def surviving(anchors: np.ndarray, planes: Planes, alive: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of those alive that may enter a list of spans, with their exact scores."""
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    score = np.broadcast_to(-(anchors.sum(1) << planes.bits)[:, None], alive.shape)  # for the 2 ** bits in each component
    exact, bit = anchors.astype(np.float64), planes.bits
    while bit >= 0 and np.count_nonzero(alive) > SPARSE * alive.size:
        # A sum of the anchor's components, so exact in a double.
        score = score + ((exact @ planes.plane(bit).T.astype(np.float64)).astype(np.int64) << bit)
        rest = (1 << bit) - 1
        if 2 * bit <= planes.bits + 1:  # before, what is missing can be as large as what is known
            alive = spans.narrowed(score + (rest * down)[:, None], score + (rest * up)[:, None], alive)
        bit -= 1
    a, r = np.nonzero(alive)
    known = score[a, r]
    while bit >= 0 and len(a):
        known = known + (np.einsum("ij,ij->i", anchors[a], planes.plane(bit, r)) << bit)
        rest = (1 << bit) - 1
        stay = spans.narrowed(known + rest * down[a], known + rest * up[a], np.ones(len(a), bool), a)
        a, r, known, bit = a[stay], r[stay], known[stay], bit - 1
    return a, r, known


@dataclass
class Block:
    """Anchors of one length: vectors x, labels, ids and row numbers, and what is asked for each: of rows with its label, or
    else of others."""

    x: np.ndarray
    label: np.ndarray
    id: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    alike: bool


@dataclass
class Held:
    """The first few of each list so far: which list (the anchor's place times lists an anchor, plus the list's), score, id
    and row number of each."""

    which: np.ndarray
    score: np.ndarray
    id: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, parts: list[Held], k: int) -> Held:
        """The first k of each list, by falling score, then id, then row number."""
        which, score, ids, rows = (np.concatenate([np.zeros(0, np.int64), *(getattr(p, f.name) for p in parts)]) for f in fields(cls))
        order = np.lexsort((rows, ids, -score, which))
        starts, sizes = _runs(which[order])
        best = order[np.arange(len(order)) - np.repeat(starts, sizes) < k]
        return cls(which[best], score[best], ids[best], rows[best])


def meet(block: Block, held: Held, x: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Held:
    """What is held after a batch of rows."""
    planes, lists = Planes(x), block.low.shape[1]
    floor = np.maximum(block.low, _kth_of_groups(held.which, held.score, k, block.low.size).reshape(block.low.shape))
    parts = [held]
    for at in range(0, len(block.x), TILE):
        own = slice(at, at + TILE)
        alive = ((block.label[own, None] == label[None, :]) == block.alike) & (block.row[own, None] != rows[None, :])
        spans = Spans(block.low[own], block.high[own], floor[own], k)
        a, r, score = surviving(block.x[own], planes, alive & (block.low[own] <= block.high[own]).any(1)[:, None], spans)
        for p in range(lists):
            fits = (score >= spans.floor[a, p]) & (score <= spans.high[a, p])
            parts.append(Held((at + a[fits]) * lists + p, score[fits], ids[r[fits]], rows[r[fits]]))
    return Held.of(parts, k)


def _searched(rows: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    """anchor (its row number), list (its place), id, score and row of each task's first k of every list; blocks: by the length
    of vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {d: Held.of([], k) for d in shared.value}
        for b in batches:
            lengths = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                if d in held:
                    part = b if (lengths == d).all() else b.filter(pa.array(lengths == d))
                    ids = part.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    held[d] = meet(shared.value[d], held[d], matrix(part.column("x")), part.column("label").to_numpy(), ids, part.column("row").to_numpy(), k)
        for d, h in held.items():
            lists = shared.value[d].low.shape[1]
            columns = [shared.value[d].row[h.which // lists], (h.which % lists).astype(np.int32), h.id, h.score, h.row]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "list", "id", "score", "row"])

    found = rows.select("row", "id", "label", "x").mapInArrow(run, "anchor long, list int, id long, score long, row long")
    rank = F.row_number().over(Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first
    `positives` other rows with its label, the first `negatives` rows of other labels whose score is from `least` to `most`
    hundredths of the positive's. anchors: a condition on the rows of df, else ids divisible by 100.

    A score is the inner product of the vectors in whole 256ths; higher ones come first, of equal ones the smaller id, then
    the row that was read first; a null id comes last. Rows without a label, a vector, or with a null or non-finite entry,
    take no part, nor do empty vectors; entries beyond 262,144 count as that, for vectors of up to 512 entries. Only vectors
    of one length have a product. Rows that repeat an id are rows of their own, as anchors too, which then repeat their
    results; only the row itself isn't its own positive. A positive with a negative score has no negatives. An empty table
    gives no rows. Further columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    store = Store(spark, "hard_negatives")
    asked = F.coalesce(anchors if anchors is not None else F.col(id_col) % 100 == 0, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vec_col)).alias("x"), asked.alias("asked")).where("label is not null and x is not null")
    rows = store.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    wanted = store.put(rows.where("asked").drop("asked"), "anchors")
    blocks = -(-wanted.count() // BLOCK)
    for i in range(blocks):
        table = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if not len(table):
            continue
        by_length = {}
        for d in pa.compute.unique(pa.compute.list_value_length(table.column("x"))).to_pylist():
            part = table.filter(pa.compute.equal(pa.compute.list_value_length(table.column("x")), d)).combine_chunks()
            label, ids, number = (part.column(c).fill_null(NO_ID).to_numpy() for c in ("label", "id", "row"))
            every = np.full((len(part), 1), LEAST), np.full((len(part), 1), NO_ID)
            by_length[d] = Block(matrix(part.column("x").chunk(0)), label, ids, number, *every, True)
        near = _searched(rows, by_length, positives).toArrow()  # `positives` rows an anchor
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, *hit in zip(*(near.column(c).to_pylist() for c in ("anchor", "rank", "id", "score")), strict=True):
            found.setdefault(a, []).append(tuple(hit))
        lists = []
        for block in by_length.values():
            block.low, block.high, block.alike = np.full((len(block.x), positives), 1), np.full((len(block.x), positives), 0), False
            for j, (row, own) in enumerate(zip(block.row.tolist(), block.id.tolist(), strict=True)):
                for rank, id_, score in found.get(row, []):
                    lists.append((row, rank - 1, own, id_, score))
                    block.low[j, rank - 1], block.high[j, rank - 1] = -(-least * score // 100), most * score // 100
        names = spark.createDataFrame(lists, "_anchor long, _list int, anchor_id long, positive_id long, positive_score long")
        met = _searched(rows, by_length, negatives).join(F.broadcast(names), (F.col("anchor") == F.col("_anchor")) & (F.col("list") == F.col("_list")))
        named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        store.add(met.select(named("anchor_id").alias("anchor_id"), named("positive_id").alias("positive_id"), "rank", named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "found")
    return store.added("found", "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
