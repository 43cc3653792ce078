"""Near-duplicate groups by SetSketch.

A document's set holds its distinct word shingles. A sketch has REGISTERS registers: each keeps the least of exponential
hashes of the set's members, truncated to a grid of powers of BASE, so registers are small integers that merge by their
maximum and agree about as often as the sets overlap. Documents with equal sets form classes first; only one of each goes
on. Bands of register values give buckets. Pairs of a bucket are tested by the joint likelihood of their registers and
exact set sizes, and what passes is confirmed on the words of both texts. With doubt=None no pair is left out by
likelihood: every pair asked for is confirmed.

No bucket is expanded into all pairs. First each bucket's members are paired with one pivot of the bucket, another one in
each band. After the components of the confirmed links, only buckets with several components are left, and of those only
pairs across components, for pairs within one can't change the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.bpe import groups_of
from lodestrum.llm.common import Store, bounded_batches, decoded, numbered_rows, texts
from lodestrum.llm.components import components

SHINGLE, SIMILARITY = 5, 75  # words; hundredths
#: With these a pair at the threshold shares no band in about one of a million cases, and unrelated ones share one
#: in 10^10.
BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
BASE, TOP = 1.02, 2000
#: A pair is left out if a similarity at the threshold or above is so much less likely than the best estimate, as a
#: difference of log-likelihoods: four standard deviations. The tests measure what that loses.
DOUBT = 8.0
#: Rows on each side of a block of one bucket, when components of a bucket are compared.
BLOCK = 1 << 14
#: Members of a set that go with a row of a block, by the least hashes: sets up to this size are compared whole there.
MEMBERS = 256
PART = 1 << 21  # bytes whose words are hashed together
#: Words of more bytes are hashed by a cryptographic function: the sums below can be made to collide by long words.
LONG_WORD = 64

_rng = np.random.default_rng(20_240_229)
MULTIPLIERS = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32) | np.uint32(1)
ADDENDS = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: powers have inverses modulo 2**64
_powers: list[np.ndarray] = []
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse for i below n or more."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PART + 4096)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (STEP, inverse)]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; equal for equal words wherever they stand."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data) and not IS_SPACE[data[end]]:
            end += 1
        a = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[True], IS_SPACE[a], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(len(a) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
        hashed = mix((sums[ends] - sums[starts]) * down[starts])
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashed[k] = int.from_bytes(hashlib.blake2b(a[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        out.append(hashed)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a document's word hashes, in order of value; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * STEP + words[k : n - width + 1 + k])
    return np.unique(h)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Register values of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * MULTIPLIERS + ADDENDS).min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 100, 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit bucket of each band, for rows of registers."""
    v = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2])
    for k in range(ROWS):
        h = mix(h * STEP + v[:, :, k] + np.uint64(1))
    return h.view(np.int64)


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)


GRID = np.linspace(0, 1, 101)


def plausible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, similarity: int = SIMILARITY, doubt: float | None = DOUBT) -> np.ndarray:
    """Which pairs of sketches may be of sets as similar as that, by the joint likelihood of greater, smaller and equal
    registers; without doubt to go by, all whose sizes allow it."""
    if doubt is None:
        return 100 * np.minimum(n_left, n_right) >= similarity * np.maximum(n_left, n_right)
    more, less = (left > right).sum(1)[:, None], (left < right).sum(1)[:, None]
    same = left.shape[1] - more - less
    u = (n_left / (n_left + n_right))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)  # the sizes allow no more
    j = GRID[None, :] * most
    above, below = _step(u - (1 - u) * j), _step(1 - u - u * j)
    like = more * np.log(above) + less * np.log(below) + same * np.log(np.clip(1 - above - below, 1e-9, 1))
    asked = np.where(100 * j >= similarity - 1e-6, like, -np.inf).max(1)
    edge = like[:, -1]
    return (100 * most[:, 0] >= similarity - 1e-9) & (np.maximum(asked, edge) >= like.max(1) - doubt)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = b.column(0), decoded(b.column(1))
        sizes, keys, registers = [], [], []
        for text in rows:
            s = shingle_hashes(word_hashes(text.encode().lower()))
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            registers.append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        keys = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS))
        ids = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.ravel(), pa.int64())], ["id", "bucket"])


def _likely(doubt: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("a_registers", "b_registers"))
                keep = plausible(left, right, b.column("a_n").to_numpy(), b.column("b_n").to_numpy(), doubt=doubt)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def shared_shingles(x: list[bytes], y: list[bytes], size: int = SHINGLE) -> tuple[int, int, int]:
    """Sizes of two texts' sets and of what they share, by the words themselves: words get numbers, shingles get numbers
    from those of their parts, and no two different ones get the same."""
    numbers: dict[bytes, int] = {}
    codes = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (x, y)]
    if len(x) < size or len(y) < size:  # a whole short sequence is only equal to itself
        n = [max(1, len(c) - size + 1) if len(c) else 0 for c in codes]
        sizes = [len({tuple(c[k : k + size].tolist()) for k in range(m)}) for c, m in zip(codes, n, strict=True)]
        return *sizes, int(x == y and len(x) > 0)
    n, bits = [len(c) - size + 1 for c in codes], max(1, (len(numbers) - 1).bit_length())
    wide = [np.concatenate([c[k : k + m] for c, m in zip(codes, n, strict=True)]) for k in range(size)]
    keys = wide[0]
    used = bits
    for part in wide[1:]:
        if used + bits > 62:  # numbered anew, so that they stay small
            keys = np.unique(keys, return_inverse=True)[1]
            used = max(1, len(keys).bit_length())
        keys, used = keys << bits | part, used + bits
    a, b = np.unique(keys[: n[0]]), np.unique(keys[n[0] :])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose full sets are similar enough. Pairs come sorted by their first text, so it's split once."""
    last: tuple = (None, None)
    for b in batches:
        keep = []
        for a, x, y in zip(b.column("a").to_pylist(), decoded(b.column("a_text")), decoded(b.column("b_text")), strict=True):
            if last[0] != a:
                last = (a, x.encode().lower().split())  # bytes are split at the white space of the contract
            n, m, both = shared_shingles(last[1], y.encode().lower().split())
            keep.append(100 * both >= SIMILARITY * (n + m - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique((shingle_hashes(word_hashes(t.encode().lower())) & np.uint64(0xFFFFFFFF)).astype("<u4"))[:MEMBERS].tobytes() for t in decoded(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["id", "members"])


def overlapping(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, similarity: int = SIMILARITY, doubt: float | None = DOUBT) -> bool:
    """May sets of these sizes be linked, by their least members? Exact for sets that are whole here, but for one hash that
    two members may share; for larger ones the likelihood of so many common ones among the least of the union."""
    both = np.intersect1d(x, y, assume_unique=True)
    if n_x <= MEMBERS and n_y <= MEMBERS:
        common = len(both) + 1
        return 100 * common >= similarity * (n_x + n_y - common)
    if doubt is None:
        return True
    least = np.union1d(x, y)[:MEMBERS]
    k, hits, at = len(least), int((both <= least[-1]).sum()), similarity / 100
    if hits >= at * k:
        return True
    j = min(max(hits / k, 1e-6), 1 - 1e-6)
    return hits * np.log(j / at) + (k - hits) * np.log((1 - j) / (1 - at)) <= doubt


def _across(best_only: bool, doubt: float | None):
    """Pairs of one block that may be linked: the left rows, which come first, against all right rows of other components.

    A pair is given in the first band that it shares, so in one bucket only. With best_only, of each left row and other
    component only the pair that agrees in most registers.
    """

    def against(left: list[tuple], right: pa.RecordBatch, bucket: int) -> pa.RecordBatch | None:
        regs = np.frombuffer(b"".join(right.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        ids, comps, sizes = (right.column(c).to_numpy() for c in ("id", "component", "n"))
        members = [np.frombuffer(m, "<u4") for m in right.column("members").to_pylist()]
        bands = regs.reshape(-1, BANDS, ROWS)
        out = []
        for x, comp, n, own_members, own in left:
            same = regs == own
            shared = (bands == own.reshape(BANDS, ROWS)).all(2)
            # The band of this bucket is the first that they share, for a pair whose buckets agree there.
            rows = np.flatnonzero((comps != comp) & (band_keys(own[None])[0][shared.argmax(1)] == bucket) & shared.any(1))
            if not len(rows):
                continue
            rows = rows[plausible(np.broadcast_to(own, (len(rows), REGISTERS)), regs[rows], np.full(len(rows), n), sizes[rows], doubt=doubt)]
            rows = np.array([k for k in rows.tolist() if overlapping(own_members, members[k], n, int(sizes[k]), doubt=doubt)], int)
            if best_only and len(rows):
                order = rows[np.argsort(-same[rows].sum(1), kind="stable")]
                rows = order[np.unique(comps[order], return_index=True)[1]]
            out += [(min(x, int(ids[k])), max(x, int(ids[k])), x, int(comps[k]), int(same[k].sum())) for k in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "x", "other", "agree"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, []
        for b in batches:
            keys = list(zip(b.column("bucket").to_pylist(), b.column("down").to_pylist(), b.column("over").to_pylist(), strict=True))
            sides = b.column("side").to_pylist()
            start = 0
            for at in range(1, len(keys) + 1):
                if at < len(keys) and keys[at] == keys[start] and sides[at] == sides[start]:
                    continue
                if keys[start] != key:
                    key, left = keys[start], []
                part = b.slice(start, at - start)
                if sides[start] == 0:
                    regs = np.frombuffer(b"".join(part.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
                    left += list(zip(part.column("id").to_pylist(), part.column("component").to_pylist(), part.column("n").to_pylist(), [np.frombuffer(m, "<u4") for m in part.column("members").to_pylist()], regs, strict=True))
                elif left and (found := against(left, part, key[0])) is not None:
                    yield found
                start = at

    return run


def across(placed: DataFrame, reps: DataFrame, docs: DataFrame, best_only: bool, doubt: float | None) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from (bucket, id, component) of buckets with several.

    The members outside a bucket's largest component are compared with all its members. Both sides are dealt in blocks of
    about BLOCK rows, so a bucket of any size is spread over tasks and none of them holds more than a block.
    """
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all_n"))
    main = main.select(F.col("bucket").alias("m_bucket"), F.col("most.component").alias("main"), F.ceil(F.col("all_n") / BLOCK).cast("int").alias("rights"), F.ceil((F.col("all_n") - F.col("most.n")) / BLOCK).cast("int").alias("lefts"))
    rows = placed.join(main, F.col("bucket") == F.col("m_bucket")).join(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "registers"), "id")
    asked = placed.select(F.col("id").alias("doc_id")).distinct()
    rows = rows.join(docs.join(asked, "doc_id", "left_semi").mapInArrow(_members, "id long, members binary"), "id")
    spot = F.xxhash64("id")
    columns = ["bucket", "down", "over", "side", "id", "component", "n", "registers", "members"]
    left = rows.where("component <> main").withColumn("side", F.lit(0)).withColumn("down", F.pmod(spot, F.col("lefts")).cast("int")).withColumn("over", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    right = rows.withColumn("side", F.lit(1)).withColumn("over", F.pmod(spot, F.col("rights")).cast("int")).withColumn("down", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
    blocks = left.select(*columns).union(right.select(*columns))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "bucket", "down", "over").sortWithinPartitions("bucket", "down", "over", "side")
    return dealt.mapInArrow(_across(best_only, doubt), "a long, b long, x long, other long, agree long")


def confirm(store: Store, pairs: DataFrame, reps: DataFrame, docs: DataFrame, doubt: float | None) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are linked; reps has the registers, docs the texts that may be asked for.

    A text may be in many pairs, as a pivot is: its pairs meet it in an inner join, whose large partitions adaptive
    execution splits.
    """
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"{c}_n"), F.col("registers").alias(f"{c}_registers"))
    likely = store.put(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_registers", "b_registers").mapInArrow(_likely(doubt), "a long, b long"), "likely")
    text = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
    met = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "a_text", "b_text")
    links = store.put(met.mapInArrow(_confirmed, "a long, b long"), "links")
    store.drop(likely)
    return links


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, doubt: float | None = DOUBT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable over links) and kept.

    Null, empty and blank texts have an empty set, link with nothing and stay. Repeated rows share a set; those with the
    id that stays all have kept. A row without an id takes the component of rows with an equal set and never links others;
    where no such row has an id, component_id is null and kept is true. Of equal sets the least id speaks for all. An id
    that repeats with different texts has the links of each, and each of its rows its own text's component. An empty table gives no rows; further columns are ignored; texts of any length are read whole. Equal sets, and set
    sizes, go by 64-bit hashes of shingles, links between different sets by the words.
    """
    bounded_batches(df.sparkSession)
    store = Store(df.sparkSession, "near")
    docs = texts(df, id_col, text_col)
    base = store.put(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, set_key binary, registers binary"), "sketches")
    # Rows of a class agree in size and registers, so partial maxima combine them before the shuffle.
    classes = store.put(base.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")), "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "n_shingles", "registers")
    buckets = reps.select("doc_id", "registers").mapInArrow(_bands, "id long, bucket long")
    several = buckets.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = store.put(buckets.join(several, "bucket", "left_semi"), "shared")
    docs = store.put(docs.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")

    pivots = shared.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id")).alias("least"))
    stars = shared.join(pivots.select("bucket", F.col("least.id").alias("pivot")), "bucket").where("id <> pivot")
    order = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    tried = store.put(stars.select(F.col("pivot").alias("x"), F.col("id").alias("y")).select(*order).distinct(), "stars")
    links = confirm(store, tried, reps, docs, doubt)
    found = components(links, store)

    for best_only in (True, False):  # the likeliest links first: what they join needs no more comparing
        placed = shared.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        placed = store.put(placed.join(mixed, "bucket", "left_semi"), "mixed")
        pairs = across(placed, reps, docs, best_only, doubt)
        if best_only:
            pairs = pairs.groupBy("x", "other").agg(F.max_by(F.struct("a", "b"), "agree").alias("p")).select("p.a", "p.b")
        pairs = store.put(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "across")
        more = confirm(store, pairs, reps, docs, doubt)
        tried = tried.union(pairs)
        store.drop(placed)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links, store)

    store.drop(docs, shared)
    of_class = classes.select("set_key", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("set_key").alias("c_key"), F.coalesce("component", "rep").alias("c_id"))
    out = base.select("doc_id", "n_shingles", "set_key").join(of_class, F.col("set_key") == F.col("c_key"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("c_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, doubt: float | None = DOUBT) -> DataFrame:
    """The rows of df of which no other reachable one has a smaller id, with all their columns: exactly one of a group.

    Rows are told apart by numbers of their own, so that one stays of rows that repeat an id or have none; of equal ids
    the row that stands first, and a row without an id only where none has one. Each row without words stays.
    """
    store = Store(df.sparkSession, "near-rows")
    rows, at = numbered_rows(store, df)
    groups = near_groups(rows, at, text_col, doubt=doubt).select(F.col("doc_id").alias("_g_row"), "component_id")
    named = rows.select(F.col(at).alias("_row"), F.col(id_col).cast("long").alias("_id")).join(groups, F.col("_row") == F.col("_g_row"))
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")).select(F.col("first._row").alias(at))
    return rows.join(kept, at, "left_semi").drop(at)
