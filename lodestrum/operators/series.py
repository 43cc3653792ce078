"""Operators over signals in long form: peaks, pyramids, ranges, features, matching."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.functions.signal import half_encode

#: Query lengths in ms with the score that chance reaches, and the level below which a frame is silent.
TAU = ((50, 0.975), (150, 0.904), (400, 0.900), (1000, 0.866), (3000, 0.830), (30000, 0.80))
SILENCE = 1e-4
#: Numbers of a frame in the queries' table; the operators take as many as a table has.
DIMS = 4
#: Frames of a query that are compared at a time, after which alignments that can't win any more are left.
STEP = 16
#: The loudness that level stands for in f0, the dimension of a frame that holds it; and the step from frame to frame in ms.
QUIET, HOP_MS = SILENCE * 12345.6, 25


def peaks(x: DataFrame, buckets: int) -> DataFrame:
    """Greatest magnitude and RMS of each of `buckets` equal parts of every series: series, bucket, peak, rms."""
    n = x.groupBy("series").agg(F.count("*").alias("n"))
    at = F.floor(F.col("i") * F.lit(float(buckets)) / F.col("n")).alias("bucket")
    return x.join(n, "series").select("series", at, "x").groupBy("series", "bucket").agg(F.least(F.max(F.abs("x")), F.lit(1.0)).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def fill_gaps(parts: DataFrame, buckets: int) -> DataFrame:
    """All buckets of each series; an empty one has the values of the last that isn't."""
    every = parts.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    w = Window.partitionBy("series").orderBy("bucket")
    got = every.join(parts, ["series", "bucket"], "left")
    return got.select("series", "bucket", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("peak", "rms")))


def pyramid(x: DataFrame, block: int, levels: int) -> DataFrame:
    """Least, greatest and sum of squares of blocks that double with each level; upper levels are made from lower ones."""
    base = x.groupBy("series", F.floor(F.col("i") / block).alias("block")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x") * F.col("x")).alias("sq")).withColumn("level", F.lit(0).cast("long"))
    out, last = base, base
    for k in range(1, levels):
        last = last.groupBy("series", F.floor(F.col("block") / 2).alias("block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sq").alias("sq")).withColumn("level", F.lit(k).cast("long"))
        out = out.unionByName(last)
    return out


def range_stats(x: DataFrame, start: int, end: int) -> DataFrame:
    return x.where((F.col("i") >= start) & (F.col("i") < end)).groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("n"))


def columns(x: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """n equal slices of each series, each a sample wide at least: a sample goes to every slice that overlaps it."""
    size = x.groupBy("series").agg(F.count("*").cast("double").alias("size"))
    y = x.join(size, "series")
    # Slice c covers [floor(c * size / n), max(that + 1, floor((c + 1) * size / n))): its candidates lie close to i * n / size.
    near = F.floor(F.col("i") * n / F.col("size"))
    wide = F.greatest(F.ceil(F.lit(n) / F.col("size")), F.lit(1)).cast("long")
    y = y.withColumn("c", F.explode(F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + wide + 1, F.lit(n - 1)).cast("long"))))
    lo = F.floor(F.col("c") * F.col("size") / n)
    hi = F.greatest(lo + 1, F.floor((F.col("c") + 1) * F.col("size") / n))
    y = y.where((F.col("i") >= lo) & (F.col("i") < hi))
    c = (F.lit(n - 1) - F.col("c")) if reverse else F.col("c")
    return y.groupBy("series", c.cast("long").alias("slice")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def delta(rows: DataFrame, value: str, order: str = "w", name: str = "d") -> DataFrame:
    """Regression slope over two frames on either side, the ends repeated."""
    w = Window.partitionBy("series").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.coalesce(F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w), F.last(value).over(whole) if k > 0 else F.first(value).over(whole))
    return rows.withColumn(name, ((at(1) - at(-1)) + 2 * (at(2) - at(-2))) / 10)


def width(rows: DataFrame, letter: str = "f") -> int:
    """How many numbers a frame has: columns f0, f1 and so on."""
    have = set(rows.columns)
    return next(d for d in range(len(have) + 1) if f"{letter}{d}" not in have)


def partial_sums(frames: DataFrame) -> DataFrame:
    """Count, sums and sums of squares over the audible frames of each series, partial aggregates that add up and can be taken
    away again, and its loudest frame, the first of equals (`attack`)."""
    n = width(frames)
    of = lambda x: F.coalesce(F.sum(F.when(F.col("f0") >= QUIET, x)), F.lit(0.0))
    sums = [of(F.col(f"f{d}")).alias(f"s{d}") for d in range(n)] + [of(F.col(f"f{d}") * F.col(f"f{d}")).alias(f"q{d}") for d in range(n)]
    attack = F.max_by(F.array(*(f"f{d}" for d in range(n))), F.struct("f0", -F.col("w")))
    return frames.groupBy("series").agg(F.count_if(F.col("f0") >= QUIET).alias("counted"), *sums, attack.alias("attack"))


def z_unit(values: list[Column]) -> Column:
    """A raw frame in standard units at length one, in a row that has the statistics m0, t0, ..."""
    z = [(v - F.col(f"m{d}")) / F.col(f"t{d}") for d, v in enumerate(values)]
    n = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    return F.array(*(F.when(n > 0, x / n).otherwise(0.0) for x in z))


def coarse_vectors(sums: DataFrame, stats: DataFrame) -> DataFrame:
    """series, mean (of its audible frames; zeros where there are none) and attack, both in standard units at length one."""
    n = width(sums, "s")
    means = [F.col(f"s{d}") / F.col("counted") for d in range(n)]
    joined = sums.join(F.broadcast(stats))  # stats is one row
    nothing = F.array(*(F.lit(0.0) for _ in range(n)))
    return joined.select("series", F.when(F.col("counted") > 0, z_unit(means)).otherwise(nothing).alias("mean"), z_unit([F.col("attack")[d] for d in range(n)]).alias("attack"))


def whole_series(frames: DataFrame) -> DataFrame:
    """series, span (frames) and all its frames in one flat array, in order: a series is a file's, so a file bounds it."""
    n = width(frames)
    one = F.array_sort(F.collect_list(F.struct("w", *(f"f{d}" for d in range(n)))))
    g = frames.groupBy("series").agg(one.alias("rows"))
    return g.select("series", F.size("rows").cast("long").alias("span"), F.flatten(F.transform("rows", lambda r: F.array(*(r[f"f{d}"] for d in range(n))))).alias("flat"))


def final_stats(parts: DataFrame) -> DataFrame:
    """Mean and spread of each dimension over partial sums of two frames or more; a spread of nothing counts as one."""
    p = parts.where("counted >= 2").withColumn("sign", F.lit(1)) if "sign" not in parts.columns else parts.where("counted >= 2")
    dims = width(parts, "s")
    total = p.agg(F.sum(F.col("counted") * F.col("sign")).alias("n"), *(F.sum(F.col(f"{k}{d}") * F.col("sign")).alias(f"{k}{d}") for k in "sq" for d in range(dims)))
    out = []
    for d in range(dims):
        mean = F.col(f"s{d}") / F.col("n")
        std = F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{d}") / F.col("n") - mean * mean))
        out += [mean.alias(f"m{d}"), F.when(std <= 1e-6, 1.0).otherwise(std).alias(f"t{d}")]
    return total.select(*out)


def z_frames(frames: DataFrame, stats: DataFrame, *keep: str, weights: list[float] | None = None) -> DataFrame:
    """Frames in standard units, times weights, at length one: series, w, z (array), and columns to keep."""
    n = width(frames)
    weights = weights or [1.0] * n
    z = frames.join(F.broadcast(stats))  # stats is one row
    # Plain columns, not array functions, so that all of it is compiled.
    z = z.select("series", "w", *keep, *(((F.col(f"f{d}") - F.col(f"m{d}")) / F.col(f"t{d}") * F.lit(float(weights[d]))).alias(f"v{d}") for d in range(n)))
    z = z.withColumn("n", F.sqrt(sum((F.col(f"v{d}") * F.col(f"v{d}") for d in range(n)), F.lit(0.0))))
    return z.select("series", "w", *keep, F.array(*(F.when(F.col("n") > 0, F.col(f"v{d}") / F.col("n")).otherwise(0.0) for d in range(n))).alias("z"))


def dot_fixed(a: Column, b: Column) -> Column:
    """The dot product of two vectors of DIMS elements, compiled."""
    return sum((a[d] * b[d] for d in range(DIMS)), F.lit(0.0))


def best_alignment(query: np.ndarray, loud: np.ndarray, other: np.ndarray, floor: float = -np.inf) -> tuple[float, int]:
    """The best mean product over all places of a shorter matrix of unit frames inside a longer one, and that place. Only
    the audible frames of the shorter one count; without any the score is -1. Of equal places the first.

    Frames still to come add from -1 to 1 each, so a place whose best end is below another's worst, or below the floor, is
    left: what scores more than the floor is exact. If nothing can reach it the score is -inf.
    """
    at = np.flatnonzero(loud)
    if not len(at):
        return -1.0, 0
    places, sums = np.arange(len(other) - len(query) + 1), np.zeros(len(other) - len(query) + 1)
    for done in range(0, len(at), STEP):
        some = at[done : done + STEP]
        if len(places) * 4 > len(other):  # most places left: one product serves all
            products = other @ query[some].T
            sums += products[places[:, None] + some[None, :], np.arange(len(some))[None, :]].sum(1)
        else:
            sums += np.einsum("pwd,wd->p", other[places[:, None] + some[None, :]], query[some])
        rest = len(at) - done - len(some)
        # A hair less, for the rounding of scores.
        least = max(sums.max() - rest, floor * len(at)) - 1e-7
        stay = sums + rest >= least
        places, sums = places[stay], sums[stay]
        if not len(places):
            return -np.inf, 0
    means = np.round(sums / len(at), 9)
    best = int(means.argmax())
    return float(means[best]), int(places[best])


def unit_frames(raw: np.ndarray, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Frames in standard units, times weights, at length one; zeros where nothing is left."""
    z = (raw - mean) / spread
    if weights is not None:
        z = z * weights
    n = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, n, out=np.zeros_like(z), where=n > 0)


def slide(query: DataFrame, candidates: DataFrame, stats: DataFrame, best: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """How well a query (one row: flat) is found in each of candidates (series, span, flat): series, off, score, swapped, span.

    Frames are put in standard units by stats (one row). A candidate that is shorter than the query slides over it instead,
    and its score is scaled by the share of the query that it covers. Every series is one call of a kernel, in the task
    that holds it; the query and the statistics are broadcast. With `best` a task gives only so many, the best of all that it
    has seen so far, so that a top-k over the result shuffles no more, and leaves what can't be among them. weights: one for
    each number of a frame, in standard units.
    """
    n = width(stats, "m")
    known = [F.array(*(F.col(f"{k}{d}") for d in range(n))).alias(name) for k, name in (("m", "means"), ("t", "spreads"))]
    given = None if weights is None else np.asarray(weights, float)
    shared = query.select(F.col("flat").alias("query")).join(stats.select(*known))  # two single rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda x: np.asarray(x, float).reshape(-1, n)

        def prepared(raw: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return unit_frames(raw, mean, spread, given), raw[:, 0] >= QUIET

        top: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            known = [np.asarray(b.column(c)[0].as_py(), float) for c in ("means", "spreads")]
            q, q_loud = prepared(matrix(b.column("query")[0].as_py()), *known)
            out = []
            floor = -np.inf if top is None or len(top) < best else top.column("score")[best - 1].as_py()
            for flat in b.column("flat"):
                c, c_loud = prepared(matrix(flat.values.to_numpy(zero_copy_only=False)), *known)
                if len(q) <= len(c):
                    score, off = best_alignment(q, q_loud, c, floor)
                    out.append((off, score, False))
                else:
                    score, _ = best_alignment(c, c_loud, q, floor * len(q) / len(c) if len(c) else -np.inf)
                    out.append((0, score * len(c) / len(q), True))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.bool_()), strict=True)]
            done = pa.RecordBatch.from_arrays([b.column("series"), *columns, b.column("span")], ["series", "off", "score", "swapped", "span"])
            if best is None:
                yield done
            else:
                seen = pa.Table.from_batches([done]) if top is None else pa.concat_tables([top, pa.Table.from_batches([done])])
                top = seen.sort_by([("score", "descending"), ("series", "ascending")]).slice(0, best)
        if top is not None:
            yield from top.combine_chunks().to_batches()

    return candidates.join(F.broadcast(shared)).mapInArrow(run, "series long, off long, score double, swapped boolean, span long")


def tau(ms: Column) -> Column:
    out = F.when(ms <= TAU[0][0], TAU[0][1])
    for (m0, t0), (m1, t1) in zip(TAU, TAU[1:], strict=False):
        out = out.when(ms <= m1, t0 + (t1 - t0) * (F.log(ms) - F.log(F.lit(m0))) / (F.log(F.lit(m1)) - F.log(F.lit(m0))))
    return out.otherwise(TAU[-1][1])


def confidence(score: Column, ms: Column) -> Column:
    t = tau(ms)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - t) / (1 - t)))


def content_hashes(rows: DataFrame) -> DataFrame:
    """(series, hash) of whole series: md5 of all numbers of their frames as 16-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames = [flat.values.to_numpy(zero_copy_only=False) for flat in b.column("flat")]
            yield pa.RecordBatch.from_arrays([b.column("series"), pa.array([hashlib.md5(half_encode(f)).hexdigest() for f in frames], pa.string())], ["series", "hash"])

    return rows.select("series", "flat").mapInArrow(run, "series long, hash string")


#: The version of fingerprints, the longest span in ms that they cover, and what may be missing of it.
VERSION, SPAN_MS, SHORT_MS = 2, 120_000, 1500


def needs_fingerprint(files: DataFrame, prints: DataFrame) -> DataFrame:
    """(path, needs) of files (path, mtime, duration_ms): is a fingerprint (path, mtime, version, span_ms) missing, of another
    time or version, or short of the file by more than SHORT_MS?"""
    p = prints.select("path", F.col("mtime").alias("_mtime"), "version", "span_ms")
    short = F.least(F.coalesce("duration_ms", F.lit(0)), F.lit(float(SPAN_MS))) - F.col("span_ms") > SHORT_MS
    fresh = (F.col("_mtime") == F.col("mtime")) & (F.col("version") == VERSION) & ~short
    return files.join(p, "path", "left").select("path", (~F.coalesce(fresh, F.lit(False))).alias("needs"))


def round_robin(colours: DataFrame, most: int) -> DataFrame:
    """brief, place and colour: of palettes (brief, image, k, colour) the first of every image, then the second and so on, each
    colour once, ignoring case, `most` of a brief. First places combine before the shuffle; distinct colours are few."""
    first = colours.groupBy("brief", F.lower("colour").alias("_c")).agg(F.min(F.struct("k", "image", "colour")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("brief").orderBy("_f"))
    return first.select("brief", place.cast("long").alias("place"), F.col("_f.colour").alias("colour")).where(F.col("place") <= most)
