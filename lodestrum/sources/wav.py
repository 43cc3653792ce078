"""WAV files as a source and a sink: folder scan, headers, samples, encoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrum.operators.catalog import has_ignored_dir, is_audio
from lodestrum.session import ship

HEADER = "rate int, channels int, bits int, format int, data_at long, data_bytes long, frames long"
FIELDS = ["rate", "channels", "bits", "format", "data_at", "data_bytes", "frames"]
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All audio files below a root: path, name, size, mtime in ms. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.select("path", name.alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    return kept.where(is_audio(F.col("name")) & ~has_ignored_dir(F.col("path")))


def probe(spark: SparkSession, root: str, seconds: float = 4.0) -> bool:
    """Is a root there? No answer in time is a no: a disc that sleeps or a share that is gone must not hold up a scan."""
    import concurrent.futures

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    pool = concurrent.futures.ThreadPoolExecutor(1)
    asked = pool.submit(lambda: bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)))
    try:
        return asked.result(seconds)
    except Exception:  # noqa: BLE001  whatever keeps it from being read
        return False
    finally:
        pool.shutdown(wait=False)


def contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root).select("path", "content")


def read_header(data: bytes) -> dict | None:
    """Format and place of the samples; sizes that run past the end are cut there. None if this is no PCM or float WAV."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        return None
    at, fmt, big = 12, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if kind == b"ds64" and len(data) >= body + 16:
            big = struct.unpack_from("<Q", data, body + 8)[0]
        elif kind == b"fmt " and len(data) >= body + 16:
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if tag == EXTENSIBLE and size >= 26 and len(data) >= body + 26:
                tag = struct.unpack_from("<H", data, body + 24)[0]
            fmt = tag, channels, rate, bits
        elif kind == b"data":
            if fmt is None:
                return None
            tag, channels, rate, bits = fmt
            if big is not None and size == 0xFFFFFFFF:
                size = big
            size = min(size, len(data) - body)
            if bits not in {PCM: (8, 16, 24, 32), FLOAT: (32, 64)}.get(tag, ()) or not channels or not rate:
                return None
            return {"rate": rate, "channels": channels, "bits": bits, "format": tag, "data_at": body, "data_bytes": size, "frames": size // (channels * bits // 8)}
        at = body + size + (size & 1)
    return None


def decode(data: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and samples as (frames, channels) in -1 to 1; what isn't a number counts as silence."""
    h = read_header(data)
    if h is None:
        return None
    raw = data[h["data_at"] : h["data_at"] + h["frames"] * h["channels"] * h["bits"] // 8]
    if h["format"] == FLOAT:
        x = np.frombuffer(raw, "<f4" if h["bits"] == 32 else "<f8").astype(np.float64)
        x = np.where(np.isnan(x), 0.0, x)
    elif h["bits"] == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif h["bits"] == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v & 0x800000) << 1)) / 8388608.0
    else:
        x = np.frombuffer(raw, f"<i{h['bits'] // 8}") / 2.0 ** (h["bits"] - 1)
    return h["rate"], x.reshape(-1, h["channels"])


def mono(x: np.ndarray) -> np.ndarray:
    """One channel as it is, n of them added and weighted by the root of 1 / n, which keeps their power."""
    return x.sum(1) / x.shape[1] ** 0.5


def encode(x: np.ndarray, rate: int, bits: int = 16, floating: bool | None = None) -> bytes:
    """A WAV file of (frames, channels): integers of 16, 24 or 32 bits, or floats of 32, which are what 32 bits mean unless
    floating is False. Integers are clamped, floats keep what goes beyond one; what isn't a number is silent."""
    floating = bits == 32 if floating is None else floating
    x = np.atleast_2d(np.asarray(x, float).T).T
    x = np.where(np.isnan(x), 0.0, x)
    if floating:
        tag, raw = FLOAT, x.astype("<f4").tobytes()
    else:
        x, top = np.clip(x, -1, 1), 2 ** (bits - 1)
        v = np.floor(np.where(x < 0, x * top, x * (top - 1)) + 0.5).astype("<i8")
        tag, raw = PCM, v.reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    block = x.shape[1] * bits // 8
    head = struct.pack("<HHIIHH", tag, x.shape[1], rate, rate * block, block, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encoded(signals: DataFrame, rate: int, bits: int = 16) -> DataFrame:
    """(path, xs) to (path, content): a WAV file of one channel for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [encode(np.asarray(xs.values, float).reshape(-1, 1), rate, bits) for xs in b.column("xs")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(files, pa.binary())], ["path", "content"])

    ship(signals.sparkSession)
    return signals.select("path", "xs").mapInArrow(run, "path string, content binary")


def headers(files: DataFrame) -> DataFrame:
    """(path, content) to path and HEADER; all null for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_header(c) or dict.fromkeys(FIELDS) for c in b.column("content").to_pylist()]
            types = [pa.int32()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array([r[f] for r in rows], t) for f, t in zip(FIELDS, types, strict=True))], ["path", *FIELDS])

    ship(files.sparkSession)
    return files.mapInArrow(run, f"path string, {HEADER}")


def samples(files: DataFrame) -> DataFrame:
    """(path, content) to path, rate and the mixed samples; files that can't be read have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(c) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([f and f[0] for f in found], pa.int32()), pa.array([None if f is None else mono(f[1]) for f in found], pa.list_(pa.float64()))], ["path", "rate", "samples"])

    ship(files.sparkSession)
    return files.mapInArrow(run, "path string, rate int, samples array<double>")
