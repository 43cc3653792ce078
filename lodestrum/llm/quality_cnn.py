"""A byte-level convolutional network in numpy that scores a text's quality.

Filters see WIDTH bytes. A filter's value at a place is the sum of one learned number for each (offset, byte), so the
network has an embedding and a convolution in one table. A text of any length is read in chunks that overlap by WIDTH - 1
bytes, so every window of the whole text is seen once; each filter is max-pooled over all chunks, and a logistic layer
combines the maxima into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.common import Sample, bounded_batches, taught, texts

WIDTH, FILTERS, CHUNK = 6, 24, 1 << 14
#: The bound of the training sample: labelled rows, whole ones.
SAMPLE_ROWS = 2400
EPOCHS, RATE = 14, 0.02
FOLDS, HELD = 3, 1


class ByteCNN:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.top = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.out = np.float32(0)
        self.pairs: np.ndarray | None = None

    def freeze(self) -> ByteCNN:
        """Sums for pairs of bytes, so that reading takes half the look-ups."""
        t = self.table
        self.pairs = np.stack([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)])
        return self

    def pooled(self, data: bytes) -> np.ndarray:
        """Each filter's maximum over all windows, at least 0; a text shorter than a window is padded by zero bytes."""
        a = np.frombuffer(data if len(data) >= WIDTH else data + bytes(WIDTH - len(data)), np.uint8)
        n = len(a) - WIDTH + 1
        most = np.zeros(FILTERS, np.float32)
        for at in range(0, n, CHUNK):
            end = min(n, at + CHUNK)  # windows of this chunk reach WIDTH - 1 bytes into the next
            part = a[at : end + WIDTH - 1]
            two = part[:-1].astype(np.int32) << 8 | part[1:]
            v = self.pairs[0].take(two[: end - at], axis=0)
            for k in range(1, WIDTH // 2):
                v += self.pairs[k].take(two[2 * k : end - at + 2 * k], axis=0)
            np.maximum(most, v.max(axis=0) + self.bias, out=most)
        return most

    def score(self, data: bytes) -> float:
        z = float(self.pooled(data) @ self.top + self.out)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _forward(net: ByteCNN, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of a text, read by chunks: each filter's maximum, and where it stands."""
    n = len(a) - WIDTH + 1
    most, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, int)
    for at in range(0, n, CHUNK):
        v = _windows(net, a, np.arange(at, min(n, at + CHUNK)))
        best = v.argmax(axis=0)
        value = v[best, np.arange(FILTERS)]
        better = value > most
        most, where = np.where(better, value, most), np.where(better, at + best, where)
    return most, where


def _windows(net: ByteCNN, a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each filter's value at these places."""
    v = net.table[0].take(a[at], axis=0)
    for k in range(1, WIDTH):
        v += net.table[k].take(a[at + k], axis=0)
    v += net.bias
    return v


def train(sample: Sample, epochs: int = EPOCHS, seed: int = 7) -> ByteCNN:
    """Gradient descent with adaptive steps, one text at a time, classes weighted equally. Without both labels the net stays
    untrained but for its constant, and gives the share of label 1."""
    net = ByteCNN(seed)
    labels = np.array([y for _, y in sample])
    if len(set(labels.tolist())) < 2:
        net.top[:] = 0
        net.out = np.float32(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        return net
    rng = np.random.default_rng(seed)
    weight = {y: len(labels) / (2 * (labels == y).sum()) for y in (0, 1)}
    data = [np.frombuffer((raw := t.encode()) + bytes(max(0, WIDTH - len(raw))), np.uint8) for t, _ in sample]
    squares = [np.full(p.shape, 1e-4, np.float32) for p in (net.table, net.bias, net.top)]
    out_square = 1e-4
    offsets = np.arange(WIDTH)
    for epoch in range(epochs):
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for i in rng.permutation(len(data)):
            a, y = data[i], int(labels[i])
            most, where = _forward(net, a)
            features = np.maximum(most, 0)
            p = 1 / (1 + np.exp(-np.clip(features @ net.top + net.out, -30, 30)))
            g = np.float32((p - y) * weight[y])
            bias = g * net.top * (most > 0)
            table = np.zeros_like(net.table)
            for f in np.flatnonzero(bias):
                table[offsets, a[where[f] + offsets], f] += bias[f]
            for param, grad, square in zip((net.table, net.bias, net.top), (table, bias, g * features), squares, strict=True):
                square *= 0.99
                square += 0.01 * grad * grad
                param -= rate * grad / np.sqrt(square + 1e-6)
            out_square = 0.99 * out_square + 0.01 * float(g) ** 2
            net.out -= np.float32(rate * g / np.sqrt(out_square + 1e-6))
    return net


def trained(docs: DataFrame, labels: DataFrame, rows: int) -> ByteCNN:
    return taught(docs, labels, "quality", FOLDS, HELD, rows, lambda sample, share: train(sample)).freeze()


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row's whole text.

    The fit reads at most `rows` labelled texts outside the held-out fold, each whole; documents whose labels contradict each other teach nothing. Texts of any length are scored whole, a null one
    as an empty one. A null id is never held out; repeated rows get the same score. An empty table gives no rows; without
    labels every score is one half. Further columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = texts(df, id_col, text_col)
    net = spark.sparkContext.broadcast(trained(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [net.value.score(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return docs.withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", *, taught_by: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df that score at least so much, with all their columns; each row has its own score, whatever its id.

    The fit reads labelled texts of `taught_by`, with the same names of id and text, or of df itself: where df has been
    filtered before, what was bad is no longer there to learn from. Null and empty texts are scored as empty ones. Without
    labels every score is one half.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    net = spark.sparkContext.broadcast(trained(texts(df if taught_by is None else taught_by, id_col, text_col), labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(text_col).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([net.value.score(t or b"") >= least for t in raw], pa.bool_()))

    return df.mapInArrow(run, df.schema)
