"""Token counts of a sentence-piece vocabulary, with huge documents counted in overlapping chunks.

A text up to `chunk` characters is encoded whole. A longer one is cut into chunks that overlap; each is encoded with the
offsets of its tokens, and neighbours are spliced where both have a token boundary at a place that is provably stable:
between two characters that stand next to each other in no piece of the vocabulary. No merge crosses such a place, so the
tokens on either side don't depend on each other. That holds before nearly every blank, and between characters that are in
no piece or that only single pieces hold. Where an overlap has no such place, it is widened, at once as far as the next
one ahead; where there is none, to the end of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lodestrum.llm.bpe import groups_of
from lodestrum.llm.common import bounded_batches, file_bytes, texts

MARK = "▁"
CHUNK, OVERLAP = 1 << 16, 256
LIMIT = 4096
MARK_BYTES = MARK.encode()


def _blank(text: bytes, at: int) -> int:
    """The length of the word mark at a place, 0 if there is none: a space, or the mark's own letter."""
    return int(text[at : at + 1] == b" ") or 3 * (text[at : at + 3] == MARK_BYTES)


def _letter(text: bytes, at: int) -> int:
    """The first place from here on where a character begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


class PieceCounter:
    def __init__(self, vocabulary: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i) and not self.model.is_control(i)]
        # Characters that stand next to each other in a piece; no merge makes anything that isn't a piece.
        self.joined = np.array(sorted({ord(a) << 32 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.spliceable = self._plain()
        self.widened = 0

    def stable(self, letters: np.ndarray) -> np.ndarray:
        """Which of the places before letters 1, 2, ... no piece can cross; letters are code points."""
        letters = np.where(letters == 32, ord(MARK), letters).astype(np.int64)
        pairs = letters[:-1] << 32 | letters[1:]
        if not len(self.joined):
            return np.ones(len(pairs), bool)
        return self.joined[np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)] != pairs

    def stable_bytes(self, text: bytes, start: int, end: int) -> np.ndarray:
        """The stable places of text between two places where characters begin."""
        part = text[start:end].decode()
        at = np.flatnonzero(self.stable(np.frombuffer(part.encode("utf-32-le"), "<u4"))) + 1
        a = np.frombuffer(text, np.uint8, end - start, start)
        return start + np.flatnonzero((a & 0xC0) != 0x80)[at]

    def _plain(self) -> bool:
        """Does the model take texts as they are, with a word mark put before them? Else offsets in chunks can't be trusted."""
        probe = "a  béé ﬁ　c\td\ne "
        pieces = "".join(p if not p.startswith("<0x") else chr(int(p[3:5], 16)) for p in self.model.encode(probe, out_type=str))
        return pieces == MARK + probe.replace(" ", MARK)

    def boundaries(self, text: bytes, start: int, end: int) -> np.ndarray:
        """Where the tokens of text[start:end] begin, as places in the text. A blank at the start is left out for the
        word mark that the model puts before every text."""
        skip = _blank(text, start) if start else 0
        spans = self.model.encode(text[start + skip : end].decode(), return_type="proto").pieces
        begins = np.array([s.begin for s in spans], np.int64)
        return start + np.where(begins > 0, begins + skip, 0)

    def count_long(self, whole: str) -> int:
        """Tokens of a text that is longer than a chunk."""
        text = whole.encode()
        n, done, total = len(text), 0, 0
        end = _letter(text, self.chunk)
        here = self.boundaries(text, done, end)
        while end < n:
            start = _letter(text, max(done, end - self.overlap))
            safe = self.stable_bytes(text, start, end)
            if not len(safe):  # widen the overlap: back as far as the chunk goes, or on to the next stable place
                self.widened += 1
                safe = self.stable_bytes(text, done, end)
                start = done
                if not len(safe[safe > done]):
                    end = self._next_stable(text, end)
                    here = self.boundaries(text, done, end)
                    continue
                start = _letter(text, max(done, int(safe[-1]) - self.overlap))
            next_end = _letter(text, max(start + self.chunk, end + self.overlap))
            there = self.boundaries(text, start, next_end)
            places = np.intersect1d(np.intersect1d(here, there), safe)
            places = places[(places > max(done, start)) & (places < end)]
            if not len(places):  # what is stable is no common boundary only at the very start of a chunk
                self.widened += 1
                end = self._next_stable(text, next_end)
                here = self.boundaries(text, done, end)
                continue
            at = int(places[len(places) // 2])
            total += int(((here >= done) & (here < at)).sum())
            done, here, end = at, there, next_end
        return total + int((here >= done).sum())

    def _next_stable(self, text: bytes, at: int) -> int:
        """A little past the next stable place from here on, or the end of the text."""
        while at < len(text):
            to = _letter(text, at + self.chunk)
            if len(safe := self.stable_bytes(text, _letter(text, max(0, at - 4)), to)):
                return _letter(text, max(at, int(safe[0])) + self.overlap)
            at = to
        return len(text)

    def count(self, batch: list[str]) -> list[int]:
        short = [t for t in batch if len(t) <= self.chunk or not self.spliceable]
        counts = iter(map(len, self.model.encode(short, num_threads=1)))
        return [next(counts) if len(t) <= self.chunk or not self.spliceable else self.count_long(t) for t in batch]


_counters: dict[tuple, PieceCounter] = {}


def counter_of(vocabulary: bytes, chunk: int, overlap: int) -> PieceCounter:
    """One counter for each Python worker and setting."""
    key = (hashlib.md5(vocabulary).digest(), chunk, overlap)
    if key not in _counters:
        _counters[key] = PieceCounter(vocabulary, chunk, overlap)
    return _counters[key]


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row's whole text.

    A null text is an empty one, with no bytes and no tokens. Ids may be null or repeat; each row is counted by itself. A
    text longer than `chunk` is counted in chunks; a vocabulary whose own rules change texts before splitting them, which is
    looked for, can't be spliced, and its texts are encoded whole. An empty table gives no rows; further columns are ignored.
    """
    bounded_batches(df.sparkSession)
    data = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(data.value, chunk, overlap)
        for b in batches:
            rows = b.column(1).to_pylist()
            tokens = [n for part in groups_of(rows) for n in counter.count(rows[part])]
            sizes = [len(t.encode()) for t in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
