"""Fingerprints of sounds, and the search for a selection of one of them in all others.

A fingerprint is a row: id, frames (how many), and data, all numbers of all frames in order as 16-bit floats. A summary is a
narrow row beside it (id, frames, counted, sums, squares, attack), so that only candidates' fingerprints are ever read: a
search ranks all summaries in one pass, and compares the few that are left frame by frame.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrum.functions import signal
from lodestrum.operators.edits import SECOND
from lodestrum.operators.series import best_alignment, confidence, unit_frames
from lodestrum.operators.similar import collapse
from lodestrum.session import ship

#: Candidates of either list for a short selection, and for one of so many ms; results, and the score from which
#: two sounds are the same; the shortest selection in samples.
CANDIDATES, LONG_CANDIDATES, LONG_MS = 250, 150, 2500
RESULTS, IDENTICAL, SHORTEST = 50, 0.97, 48


@dataclass(frozen=True)
class Layout:
    """Numbers of a frame, which of them is loudness, the level from which a frame is audible, and ms from frame to frame."""

    width: int
    loud: int
    quiet: float
    hop_ms: float

    def matrix(self, data: bytes | Sequence[float]) -> np.ndarray:
        """The frames of a fingerprint, from its 16-bit floats or from plain numbers."""
        flat = signal.half_decode(data) if isinstance(data, bytes) else np.asarray(data)
        return flat.astype(float).reshape(-1, self.width)


#: What signal.frame_features makes of a sound: its loudness is a logarithm.
SPECTRAL = Layout(44, 42, float(np.log(1e-4)), 1000 * signal.HOP / signal.RATE)


@dataclass
class Statistics:
    """Mean and spread of every number over the audible frames of all sounds."""

    mean: np.ndarray
    spread: np.ndarray


def axis_weights(timbre: float = 1.0, brightness: float = 1.0, texture: float = 1.0, energy: float = 0.5, transient: float = 0.8) -> list[float]:
    """Weights of a spectral frame's numbers from five axes, as edits.axis_weights() has them for columns."""
    block = lambda first, rest: [first, *[rest] * (signal.CEPSTRA - 1)]
    second = [w * SECOND for w in block(energy, transient)]
    return [*block(energy, timbre), *block(energy, transient), *second, brightness, texture, brightness, energy, transient]


def fingerprints(sounds: DataFrame) -> DataFrame:
    """id, frames and data of sounds (id, rate, samples): each is resampled to the rate of the features where it has another.
    A sound without samples has no fingerprint."""
    ship(sounds.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, rate, xs in zip(*(b.column(c).to_pylist() for c in ("id", "rate", "samples")), strict=True):
                if xs:
                    f = features(np.asarray(xs, float), rate)
                    out.append((id_, len(f), signal.half_encode(f)))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["id", "frames", "data"])

    return sounds.select(F.col("id").cast("long").alias("id"), F.col("rate").cast("int").alias("rate"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, "id long, frames int, data binary")


def features(pcm: np.ndarray, rate: int) -> np.ndarray:
    return signal.frame_features(pcm if rate == signal.RATE else signal.polyphase(pcm, rate, signal.RATE))


def summary(m: np.ndarray, layout: Layout) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many frames are audible, their sum and sum of squares, and the loudest frame, the first of equals."""
    own = m[m[:, layout.loud] >= layout.quiet]
    attack = m[int(m[:, layout.loud].argmax())] if len(m) else np.zeros(layout.width)
    return len(own), own.sum(0), (own * own).sum(0), attack


def summaries(prints: DataFrame, layout: Layout = SPECTRAL) -> DataFrame:
    """id, frames, counted, sums, squares, attack and hash (of all numbers as 16-bit floats); store them as a table beside the
    fingerprints."""
    ship(prints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.float64())
        for b in batches:
            found = [layout.matrix(d) for d in b.column("data").to_pylist()]
            parts = [summary(m, layout) for m in found]
            hashes = [hashlib.md5(signal.half_encode(m)).hexdigest() for m in found]
            lists = [pa.array([p[k] for p in parts], numbers) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("frames"), pa.array([p[0] for p in parts], pa.int64()), *lists, pa.array(hashes, pa.string())], ["id", "frames", "counted", "sums", "squares", "attack", "hash"])

    return prints.select("id", F.col("frames").cast("int").alias("frames"), "data").mapInArrow(run, "id long, frames int, counted long, sums array<double>, squares array<double>, attack array<double>, hash string")


def statistics(sums: DataFrame, layout: Layout = SPECTRAL) -> Statistics | None:
    """Over summaries of two audible frames or more, None if there are none; a spread of nothing counts as one. Sums are added
    number by number, so the driver gets a row for each number of a frame."""
    each = sums.where("counted >= 2").select("counted", F.posexplode(F.arrays_zip("sums", "squares")).alias("d", "v"))
    rows = each.groupBy("d").agg(F.sum("counted").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q")).collect()
    if not rows:
        return None
    s, q = np.zeros(layout.width), np.zeros(layout.width)
    for r in rows:
        s[r["d"]], q[r["d"]] = r["s"] / r["n"], r["q"] / r["n"]
    spread = np.sqrt(np.maximum(0, q - s * s))
    return Statistics(s, np.where(spread <= 1e-6, 1.0, spread))


def ranked_summaries(sums: DataFrame, query: np.ndarray, stats: Statistics, k: int, layout: Layout = SPECTRAL, exclude: DataFrame | None = None) -> DataFrame:
    """The k sounds whose mean frame is most like the query's, and the k whose loudest frame is: which (0 or 1), id, score,
    rank. All summaries are read once; a task sends k rows of either list."""
    counted, total, _, attack = summary(query, layout)
    wanted = unit_frames(np.stack([total / max(counted, 1), attack]), stats.mean, stats.spread)
    rest = sums if exclude is None else sums.join(exclude.select("id").distinct(), "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 2)), np.zeros((0, 2))]
        ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("counted").to_numpy(zero_copy_only=False)
            total, attacks = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("sums", "attack"))
            means = unit_frames(total / np.maximum(n, 1)[:, None], stats.mean, stats.spread) * (n > 0)[:, None]
            for which, units in enumerate((means, unit_frames(attacks, stats.mean, stats.spread))):
                scores = np.concatenate([best[which][:, 0], np.round(units @ wanted[which], 9)])
                own = np.concatenate([ids[which], b.column("id").to_numpy()])
                order = np.lexsort((own, -scores))[:k]
                best[which], ids[which] = np.stack([scores[order]] * 2, 1), own[order]
        for which in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[which]), which, np.int32)), pa.array(ids[which]), pa.array(best[which][:, 0].copy())], ["which", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("which").orderBy(F.desc("score"), "id"))
    return rest.select("id", "counted", "sums", "attack").mapInArrow(run, "which int, id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)


def aligned(prints: DataFrame, query: np.ndarray, stats: Statistics, layout: Layout = SPECTRAL, weights: Sequence[float] | None = None, keep: int | None = None) -> DataFrame:
    """How well a query's frames are found in each fingerprint: id, score, off (frames), swapped, frames. weights: one for each
    number, in standard units. With `keep` a task gives only so many, and leaves alignments that can't be among them; what it
    gives is exact. A sound shorter than the query slides over it, and its score is the share that it covers of it."""
    w = None if weights is None else np.asarray(weights, float)
    q, q_loud = unit_frames(query, stats.mean, stats.spread, w), query[:, layout.loud] >= layout.quiet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        best: list[float] = []  # a heap of the `keep` best scores so far
        for b in batches:
            for id_, data in zip(b.column("id").to_pylist(), b.column("data").to_pylist(), strict=True):
                m = layout.matrix(data)
                if not len(m):
                    continue
                floor = best[0] if keep and len(best) == keep else -np.inf
                c, swapped = unit_frames(m, stats.mean, stats.spread, w), len(q) > len(m)
                if swapped:
                    share = len(c) / len(q)
                    score, off = best_alignment(c, m[:, layout.loud] >= layout.quiet, q, floor / share)[0] * share, 0
                else:
                    score, off = best_alignment(q, q_loud, c, floor)
                if np.isfinite(score) and score >= floor:
                    held.append((-score, id_, off, swapped, len(m)))
                    if keep:
                        (heapq.heappushpop if len(best) == keep else heapq.heappush)(best, score)
            if keep and len(held) > keep:
                held = sorted(held)[:keep]
        held = sorted(held)[:keep] if keep else held
        columns = list(zip(*held, strict=True)) or [[]] * 5
        types = (pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
        score, *others = (pa.array(list(c), t) for c, t in zip(columns, types, strict=True))
        yield pa.RecordBatch.from_arrays([others[0], pa.array(-score.to_numpy(zero_copy_only=False)), *others[1:]], ["id", "score", "off", "swapped", "frames"])

    return prints.select("id", "data").mapInArrow(run, "id long, score double, off long, swapped boolean, frames int")


def selection(pcm: np.ndarray, rate: int, before: int = 0, after: int = 0) -> np.ndarray | str:
    """The frames of a selection that stands in `before` and `after` samples of its surroundings, by which its first and last
    slopes are made; or why there are none: too-short or silent."""
    x = np.asarray(pcm, float)
    if rate != signal.RATE:
        k = signal.RATE / rate
        x, before, after = signal.polyphase(x, rate, signal.RATE), round(before * k), round(after * k)
    n = len(x) - before - after
    if n < SHORTEST:
        return "too-short"
    f = signal.frame_features(x)
    wanted = max(1, (n - signal.SIZE) // signal.HOP + 1)
    first = min(round(before / signal.HOP), max(0, len(f) - wanted))
    out = f[first : first + wanted]
    return out if summary(out, SPECTRAL)[0] else "silent"


def echo(
    prints: DataFrame,
    sums: DataFrame,
    query: np.ndarray | str,
    layout: Layout = SPECTRAL,
    stats: Statistics | None = None,
    weights: Sequence[float] | None = None,
    exclude: DataFrame | None = None,
    query_ms: float | None = None,
    limit: int = RESULTS,
    keep: int | None = None,
    around: np.ndarray | None = None,
) -> DataFrame | dict:
    """Where a selection's frames (see selection()) are found in all fingerprints, best first: id, similarity, confidence,
    identical, weak, offset_ms, duration_ms and copies, the ids of the same content among the candidates.

    sums: the fingerprints' summaries. Candidates are the most similar by mean frame and by loudest frame; those that exclude
    (id) has are never among them. With `around`, the frames of the sound that the selection is of, these are compared there
    and not the selection's. An empty library, a selection that is silent or too short gives {"error": ...}.
    Making the plan takes one job for the statistics, unless they are given.
    """
    if isinstance(query, str):
        return {"error": query}
    ship(prints.sparkSession)
    stats = statistics(sums, layout) if stats is None else stats
    if stats is None:
        return {"error": "empty"}
    ms = len(query) * layout.hop_ms if query_ms is None else query_ms
    k = LONG_CANDIDATES if ms >= LONG_MS else CANDIDATES
    picked = ranked_summaries(sums, query if around is None else around, stats, k, layout, exclude).select("id").distinct()  # 2 * k at most
    found = prints.join(F.broadcast(picked), "id", "left_semi")
    known = F.broadcast(picked).join(sums.select("id", "hash"), "id")
    hits = aligned(found, query, stats, layout, weights, keep).join(F.broadcast(known), "id")
    first = collapse(hits, F.col("hash"), F.struct(-F.col("score"), "id")).select("id", "copies")
    out = hits.join(first, "id").orderBy(F.desc("score"), "id").limit(limit)
    sure, span, offset = confidence(F.col("score"), F.lit(float(ms))), F.col("frames") * layout.hop_ms, F.col("off") * layout.hop_ms
    length = F.when(F.col("swapped"), span).otherwise(F.least(F.lit(float(ms)), span - offset))
    return out.select(
        "id", F.col("score").alias("similarity"), sure.alias("confidence"), (F.col("score") >= IDENTICAL).alias("identical"), (sure <= 0).alias("weak"),
        F.when(F.col("swapped"), 0.0).otherwise(offset).cast("long").alias("offset_ms"), F.greatest(F.lit(1), F.round(length)).cast("long").alias("duration_ms"), "copies",
    )
