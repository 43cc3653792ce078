"""Byte-level BPE by speculation and verification, and decoding.

Words come from the usual byte-level pattern. For each word that isn't known yet a greedy longest match proposes
tokens. A sequence of tokens is the BPE encoding of its bytes exactly if every token encodes to itself and every adjacent
pair encodes to itself, so one vectorised check over all adjacent pairs of all new words tells which proposals are right;
only the others are merged in rank order. Checked words are kept in two generations of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrum.llm.common import bounded_batches, file_bytes, texts

#: The pattern of byte-level BPE vocabularies of this family: a fixed value of the format.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of one generation, and the longest word in characters that is kept.
KEPT_WORDS, KEPT_CHARS = 200_000, 48


def byte_letters() -> dict[str, int]:
    """The format's letters for bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file; ids and texts as the file's own library gives them."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = raw(t)
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Ranks are positions in the merge list; bytes rank before all merges. Tables below are by id.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.zeros(size, np.int64)
        for r, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((a, b), (r, c))
            if self.left[c] == c:
                self.left[c], self.right[c], self.rank[c] = a, b, r + 1
        pairs = np.array(sorted((a << 32 | b, r + 1) for (a, b), (r, _) in self.merge.items()), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.longest: dict[bytes, int] = {}  # by the first two bytes
        for t in self.id_of:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        self.sound = np.zeros(size, np.int8)  # does a token encode to itself? 0: not known yet, 1: yes, 2: no
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    # proposing, checking, merging

    def propose(self, word: bytes) -> list[int]:
        out, at, n, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            end = at + min(n - at, longest.get(word[at : at + 2], 1))
            while (token := id_of.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, a large number where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does each pair of sound tokens encode to itself? Both tokens are taken apart along the seam, the later merge
        first; a merge across the seam that would come before the last one undone speaks against the pair."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            bad = self.combined(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            # Equal merges on both sides happen left first, so the right token's comes apart first then.
            from_left = ra > rb
            step = np.maximum(ra, rb)
            go = ~bad & (step > 0)
            # A merge across the seam at the rank of an undone left merge came after it; at that of a right one, before it.
            limit = np.where(from_left, step, step + 1)
            na, nb = np.where(from_left, self.right[a], a), np.where(from_left, b, self.left[b])
            live, a, b, limit = live[go], na[go], nb[go], limit[go]
        return ok

    def merged(self, word: bytes) -> list[int]:
        """The encoding by definition: the lowest rank first, the leftmost of equals; a heap over linked symbols."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, merge = len(ids), self.merge
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merge.get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        tokens = [self.propose(w) for w in raw]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, int(counts.sum()))
        for t in np.unique(flat[self.sound[flat] == 0]).tolist():
            self.sound[t] = 1 if self.merged(self.bytes_of[t]) == [t] else 2
        word_of = np.repeat(np.arange(len(words)), counts)
        good = np.ones(len(words), bool)
        good[word_of[self.sound[flat] != 1]] = False
        seam = np.flatnonzero(word_of[1:] == word_of[:-1])
        pair, back = np.unique(flat[seam] << 32 | flat[seam + 1], return_inverse=True)
        fits = self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
        good[word_of[seam[~fits]]] = False
        ids = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        starts = [0, *ends[:-1]]
        return [ids[s:e] if g else np.array(self.merged(w), "<u4").tobytes() for g, s, e, w in zip(good.tolist(), starts, ends, raw, strict=True)]

    # texts

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of words that aren't kept yet; those of the older generation move to the new one as they are used."""
        out, unknown = {}, []
        for w in words:
            if (x := self.old.get(w)) is None:
                unknown.append(w)
            else:
                out[w] = x
        out.update(zip(unknown, self.encode_words(unknown), strict=True))
        for w, x in out.items():
            if len(w) <= KEPT_CHARS:
                self.new[w] = x
        if len(self.new) >= KEPT_WORDS:
            self.old, self.new = self.new, {}
        return out

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without added tokens; a special token's own text gives its id."""
        parts = []
        for text in batch:
            if self.split and self.split.search(text):
                at, out = 0, []
                for m in self.split.finditer(text):
                    out += [*WORDS.findall(text[at : m.start()]), self.special[m.group()]]
                    at = m.end()
                parts.append(out + WORDS.findall(text[at:]))
            else:
                parts.append(WORDS.findall(text))
        known = self.new
        missing = {w for p in parts for w in p if w not in known}
        specials = {w: w.to_bytes(4, "little") for w in missing if isinstance(w, int)}
        missing -= specials.keys()
        more = self._learn(missing) | specials if missing or specials else {}
        if not more:
            return [b"".join(map(known.__getitem__, p)) for p in parts]
        get = more.get
        return [b"".join([known[w] if (x := get(w)) is None else x for w in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the text; ids as encode_batch gives them."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[bytes, ByteBPE] = {}


def coder(vocabulary: bytes) -> ByteBPE:
    """One coder for each Python worker and vocabulary."""
    key = hashlib.md5(vocabulary).digest()
    if key not in _coders:
        _coders[key] = ByteBPE(vocabulary)
    return _coders[key]


#: Characters of texts that are encoded together.
TOGETHER = 1 << 20


def groups_of(rows: list[str], most: int = TOGETHER) -> Iterator[slice]:
    """Consecutive texts of about `most` characters together."""
    start = held = 0
    for i, t in enumerate(rows):
        held += len(t)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(rows):
        yield slice(start, len(rows))


def per_text(df: DataFrame, vocabulary: str, make: Callable[[ByteBPE, str, bytes], tuple], fields: str) -> DataFrame:
    """A row (doc_id, *make(coder, text, ids)) for every row of (doc_id, text)."""
    data = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    schema = f"doc_id long, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, types = coder(data.value), None
        for b in batches:
            doc_ids, rows = b.column(0), b.column(1).to_pylist()
            out: list[tuple] = []
            for part in groups_of(rows):
                out += [make(bpe, t, x) for t, x in zip(rows[part], bpe.encode_batch(rows[part]), strict=True)]
            types = types or arrow_types(fields)
            if out:
                yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", *(n for n, _ in types)])

    return df.mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def arrow_types(fields: str) -> list[tuple[str, pa.DataType]]:
    return [(n, ARROW[t]) for n, t in (f.split() for f in fields.split(", "))]


def encode_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    A null text is an empty one: no tokens, the digests of nothing. Ids may be null or repeat; each row is encoded by
    itself. Texts and words of any length are encoded whole, in time nearly proportional. Of merges of equal rank the
    leftmost comes first. An empty table gives no rows; further columns are ignored.
    """
    bounded_batches(df.sparkSession)

    def make(bpe: ByteBPE, _: str, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return per_text(texts(df, id_col, text_col), vocabulary, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every row as little-endian unsigned 32-bit integers in a binary column `ids`; awkward rows as in
    encode_digests."""
    bounded_batches(df.sparkSession)
    return per_text(texts(df, id_col, text_col), vocabulary, lambda _, __, ids: (ids,), "ids binary")
