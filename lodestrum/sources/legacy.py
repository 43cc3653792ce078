"""Older formats: compressed fingerprint matrices, collections in one JSON document, category lists in spreadsheets."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrum.functions.signal import half_encode
from lodestrum.session import ship

#: Dimensions of a fingerprint frame, which of them is loudness, and the level of silence there.
DIMS, LOUDNESS, SILENT = 44, 42, float(np.log(1e-4))
CONVERTED = "path string, mtime long, windows int, span_ms int, counted int, hash string, sums array<double>, attack array<float>, data binary, state string"


def normalised_by_itself(frames: np.ndarray) -> bool:
    """Was this matrix put in standard units by its own mean and spread, which makes it useless?"""
    if len(frames) < 2:
        return False
    mean, spread = frames.mean(0), frames.std(0)
    ones = np.abs(spread - 1) < 1e-3
    return bool((np.abs(mean) <= 1e-3).all() and (ones | (spread <= 1e-6)).all() and ones.any())


def converted(packed: bytes | None, windows: int | None) -> dict:
    """What a compressed matrix of 32-bit floats becomes: sums, loudest frame, 16-bit floats; or its state tells why not."""
    try:
        raw = np.frombuffer(zlib.decompress(packed or b""), np.uint8)
        frames = raw[: len(raw) // 4 * 4].view("<f4")
        if not windows or len(frames) < windows * DIMS:
            return {"state": "failed"}
    except zlib.error:
        return {"state": "failed"}
    frames = frames[: windows * DIMS].reshape(windows, DIMS).astype(np.float64)
    if normalised_by_itself(frames):
        return {"state": "dropped"}
    loud = frames[frames[:, LOUDNESS] >= SILENT]
    data = half_encode(frames)
    sums = np.concatenate([loud.sum(0), (loud * loud).sum(0)])
    return {"state": "converted", "windows": windows, "counted": len(loud), "hash": hashlib.md5(data).hexdigest(), "sums": sums.tolist(), "attack": frames[frames[:, LOUDNESS].argmax()].tolist(), "data": data}


def migrate(old: DataFrame) -> DataFrame:
    """(path, mtime, windows, span_ms, matrix) to CONVERTED, a row for each with its state; each file by itself."""
    names, types = [f.split()[0] for f in CONVERTED.split(", ")], (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r | converted(r["matrix"], r["windows"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    ship(old.sparkSession)
    return old.select("path", "mtime", "windows", "span_ms", "matrix").mapInArrow(run, CONVERTED)


def collections(spark: SparkSession, path: str) -> DataFrame:
    """Collections of a JSON document {name: [paths], __colors: {name: colour}}: collection, pos, path, color. A document that
    can't be read has none."""
    text = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", "map<string, string>")
    doc = text.select(lists.alias("doc")).where("doc is not null")
    colours = F.from_json(F.col("doc")["__colors"], "map<string, string>")
    each = doc.select(F.explode(F.map_filter("doc", lambda k, _: k != "__colors")).alias("collection", "paths"), colours.alias("colours"))
    return each.select("collection", F.posexplode(F.from_json("paths", "array<string>")).alias("pos", "path"), F.try_element_at("colours", F.col("collection")).alias("color"))


def sheet_rows(data: bytes) -> list[dict[str, str]]:
    """Cells of a workbook's first sheet, by column letters, a dictionary for each row."""
    book = zipfile.ZipFile(io.BytesIO(data))
    text = lambda node: "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))
    shared = [text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    out = []
    for row in ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row"):
        cells = {}
        for c in row:
            value = next((v.text or "" for v in c if v.tag.endswith("}v")), None)
            cells[re.match("[A-Z]+", c.get("r", "")).group()] = text(c) if value is None else shared[int(value)] if c.get("t") == "s" else value
        out.append(cells)
    return out


def categories(spark: SparkSession, path: str) -> DataFrame:
    """The category list of a spreadsheet: cat, sub, cat_id, cat_short, explanation, synonyms. Rows above the heading, and those
    without the first three, are none. One file of a fixed size."""
    rows = sheet_rows(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    head = next(k for k, r in enumerate(rows) if r.get("A") == "Category" and r.get("C") == "CatID")
    kept = [[r.get(c, "").strip() for c in "ABCDEF"] for r in rows[head + 1 :] if r.get("A") and r.get("B") and r.get("C")]
    return spark.createDataFrame([(*r[:5], [s.strip() for s in r[5].split(",") if s.strip()]) for r in kept], "cat string, sub string, cat_id string, cat_short string, explanation string, synonyms array<string>")
