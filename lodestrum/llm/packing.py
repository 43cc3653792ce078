"""Packing token sequences by minimum bin slack.

A task encodes its documents, each with an end token. Whole windows of a document are sequences by themselves; what
remains of each document, shorter than a window, goes to a pool. Sequences are filled from the pool: the longest
remainder opens one, and a subset-sum program over the multiset of remaining lengths, kept as bitsets, finds the fill
closest to the capacity, with counts of each length by backtracking. Where no exact fill exists, the longest remainder
is cut to close the gap.

A task ends with less than a window of tokens that fill no sequence. These rests, a window a task at most, meet in a
second step: those of GATHER tasks are packed together, and only the last sequence of each such group has padding. What
the first step gives is written once to the shared folder, without texts; only rests are shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.bpe import WORDS, ByteBPE, coder, groups_of
from lodestrum.llm.common import Store, bounded_batches, decoded, file_bytes, texts

WINDOW, END = 2048, 1
#: Remainders that a task holds before it fills sequences; it stops filling at half of them, but for the last time.
POOL = 2048
#: Tasks whose rests are packed together.
GATHER = 1024
#: Texts over so many characters are encoded by the package's own coder: the compiled one gives up on runs of white space
#: of about a million, and its time for one long word isn't proportional.
COMPILED_CHARS = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes as close to capacity as any choice does, without exceeding it."""
    mask, reach = (1 << capacity + 1) - 1, 1
    steps: list[tuple[int, int]] = []  # a length, and what was reachable before it
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        steps.append((length, reach))
        left, power = counts[length], 1
        while left:  # 1, 2, 4, ... copies reach every count up to the one there is
            take = min(power, left)
            reach |= reach << take * length & mask
            left, power = left - take, power * 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + 1
            at -= length
    return chosen

class Packer:
    """Takes the ids of documents one by one and gives rows of SCHEMA."""

    def __init__(self, first_sequence: int, window: int = WINDOW, pool: int = POOL) -> None:
        self.window, self.pool, self.next = window, pool, first_sequence
        self.by_length: dict[int, deque] = {}
        self.held = 0
        self.rows: list[tuple] = []
        self.rest: list[tuple] = []

    def hold(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        self.by_length.setdefault(len(ids) // 4, deque()).append((doc_id, start, ids, total))
        self.held += 1

    def take(self, length: int) -> tuple:
        queue = self.by_length[length]
        piece = queue.popleft()
        if not queue:
            del self.by_length[length]
        self.held -= 1
        return piece

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = total // self.window
        for k in range(whole):
            self.sequence([(doc_id, k * self.window, ids[k * step : (k + 1) * step], total)])
        if len(ids) > whole * step:
            self.hold(doc_id, whole * self.window, ids[whole * step :], total)
        if self.held >= self.pool:
            self.fill(self.pool // 2)

    def fill(self, down_to: int = 0, last: bool = True) -> None:
        """Fill sequences until at most so many remainders are held. The last one, if it isn't full, becomes a sequence
        where `last` says so; else its pieces are left in `rest`."""
        while self.held > down_to:
            pieces = [self.take(max(self.by_length))]
            room = self.window - len(pieces[0][2]) // 4
            for length, n in best_fill({k: len(q) for k, q in self.by_length.items()}, room).items():
                pieces += [self.take(length) for _ in range(n)]
                room -= n * length
            if room and self.held:  # all that are left are longer than the room: cut the longest
                doc_id, start, ids, total = self.take(max(self.by_length))
                pieces.append((doc_id, start, ids[: 4 * room], total))
                self.hold(doc_id, start + room, ids[4 * room :], total)
                room = 0
            if room and not last:
                self.rest = pieces
            else:
                self.sequence(pieces)


def encoder(bpe: ByteBPE) -> tiktoken.Encoding:
    """The same vocabulary in a compiled encoder, made once for each coder."""
    if not hasattr(bpe, "compiled"):
        bpe.compiled = tiktoken.Encoding("vocabulary", pat_str=WORDS.pattern, mergeable_ranks={bpe.bytes_of[i]: i for i in bpe.id_of.values()}, special_tokens=bpe.special)
    return bpe.compiled


def ids_of(bpe: ByteBPE, text: str) -> bytes:
    """Ids of a text of any kind and length, as little-endian 32-bit integers."""
    if len(text) > COMPILED_CHARS:
        return bpe.encode_batch([text])[0]
    return encoder(bpe).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def _table(rows: list[tuple], rest: list[tuple], task: int) -> pa.RecordBatch:
    """Finished pieces, and pieces of a rest with their ids and task; the former have no ids."""
    n = len(rows) + len(rest)
    columns = list(zip(*rows, *((d, s, len(ids) // 4, 0, total, 0, 0) for d, s, ids, total in rest), strict=True)) if n else [[]] * 7
    ids = [None] * len(rows) + [ids for _, _, ids, _ in rest]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary()), pa.array([task] * n, pa.int64())], [*NAMES, "ids", "task"])


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, pool: int = POOL, end: int = END, gather: int = GATHER) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one: its document is the end token alone. Ids may be null or repeat, each row is a document.
    A text of any length is encoded whole and its pieces may be cut anywhere. Of remainders of equal length the one that
    came first is taken. Sequence ids are unique, with gaps. An empty table gives no rows; further columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    data = spark.sparkContext.broadcast(file_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = coder(data.value), TaskContext.get().partitionId()
        packer, last = Packer(task << 32, window, pool), end.to_bytes(4, "little")
        for b in batches:
            ids, found = b.column(0).to_pylist(), decoded(b.column(1))
            for part in groups_of(found):
                for doc_id, text in zip(ids[part], found[part], strict=True):
                    packer.add(doc_id, ids_of(bpe, text) + last)
                if packer.rows:
                    yield _table(packer.rows, [], task)
                    packer.rows = []
        packer.fill(last=False)
        yield _table(packer.rows, packer.rest, task)

    def gathered(rests: pa.Table) -> pa.Table:
        """The rests of some tasks, a window each at most, as sequences; the order of tasks decides, not that of arrival."""
        rests = rests.sort_by([("task", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        group = rests.column("task")[0].as_py() // gather
        packer = Packer(1 << 62 | group << 32, window, max(2, len(rests) + 1))
        for doc_id, start, ids, total in zip(*(rests.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.hold(doc_id, start, ids, total)
        packer.fill()
        return pa.Table.from_batches([_table(packer.rows, [], 0)]).select(NAMES)

    store = Store(spark, "packing")
    first = store.put(texts(df, id_col, text_col).mapInArrow(run, f"{SCHEMA}, ids binary, task long"), "pieces")
    rests = first.where("ids is not null").groupBy(F.floor(F.col("task") / gather)).applyInArrow(gathered, SCHEMA)
    return first.where("ids is null").select(*NAMES).union(rests)
