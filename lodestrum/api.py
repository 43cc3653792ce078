"""The library's public face: a catalogue with searching, listing and recommending. What is returned is lazy, but some
plans ask for small things first: suggest() and neighbours() for query vectors, echo() for statistics.

What can't be answered comes back as a row-less result or an `error` value, not as an exception.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrum.operators import catalog, fingerprints, search, similar
from lodestrum.operators.postings import Postings
from lodestrum.sources.wav import scan

#: Bounds and defaults of limits.
LEXICAL, AI, SUGGEST = (1, 5000, 2000), (1, 2000, 500), (1, 100, 24)


def clamp(n: int | None, bounds: tuple[int, int, int]) -> int:
    return max(bounds[0], min(bounds[1], bounds[2] if n is None else int(n)))


class Catalog:
    """entries (id, name, dir, top_level, size, mtime, path), vectors (id, vec) and fingerprints (id, frames, data) of the same
    files; with fingerprints their summaries, if there is a table of them. Names are found in a stored index, if one is given,
    or else in the listing."""

    def __init__(self, entries: DataFrame, vectors: DataFrame | None = None, prints: DataFrame | None = None, summaries: DataFrame | None = None, names: Postings | None = None) -> None:
        self.entries, self.vectors, self.names = entries, vectors, names
        self.prints, self.summaries = prints, summaries if summaries is not None or prints is None else fingerprints.summaries(prints)
        self.index = search.indexed(entries)

    @classmethod
    def of_folder(cls, spark, root: str) -> Catalog:
        """All audio files below a root; the path's hash is the id."""
        found = scan(spark, root)
        below = re.sub("^file:/*(?=/)", "", root).rstrip("/") + "/"
        plain = F.regexp_replace("path", "^file:/*(?=/)", "")
        rel = F.when(F.startswith(plain, F.lit(below)), F.substring(plain, len(below) + 1, 1 << 30)).otherwise(plain)
        e = found.withColumn("path", rel).withColumn("id", F.xxhash64("path"))
        name, folder, top = catalog.split_path(F.col("path"))
        return cls(e.select("id", name, folder, top, "size", "mtime", "path"))

    def status(self) -> DataFrame:
        n = self.entries.agg(F.count("*").alias("files"))
        v = self.vectors.agg(F.count("*").alias("vectors")) if self.vectors is not None else n.select(F.lit(0).cast("long").alias("vectors"))
        return n.join(v)  # two single rows

    def tree(self) -> DataFrame:
        return catalog.folder_tree(self.entries)

    def list(self, folder: str = "", recursive: bool = True, sort: str = "name") -> DataFrame:
        rows = self.entries.where(catalog.in_folder(F.col("dir"), folder, recursive))
        name, folder_key = catalog.natural_key(F.col("name")), catalog.natural_key(F.col("dir"))
        orders: dict[str, list[Column]] = {"date": [F.desc("mtime"), name], "size": [F.desc("size"), name], "path": [folder_key, name]}
        return rows.orderBy(*orders.get(sort, [name, folder_key]), "id")

    def resolve(self, paths: DataFrame) -> DataFrame:
        return catalog.resolve(self.entries, paths)

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        """Names that match; a query in Spanish is also looked for in English, the original's hits first."""
        found = search.bilingual(self.names or self.index, text, clamp(limit, LEXICAL), Postings.search if self.names else search.lexical)
        return found.orderBy("rank").drop("src")

    def hybrid(self, text: str, query: DataFrame, limit: int | None = None) -> DataFrame | dict:
        """Names and sounds together, for a query text and its vector (qvec)."""
        if self.vectors is None:
            return {"error": "notReady"}
        n = clamp(limit, AI)
        find = self.names.search if self.names else partial(search.lexical, self.index)
        names = find(text.strip(), LEXICAL[1], partial=False).where("not partial")
        ai = search.vector_top(self.vectors, query, n).join(self.entries.select("id"), "id", "left_semi")
        scores = self.vectors.join(F.broadcast(query)).select("id", search.dot(F.col("vec"), F.col("qvec")).alias("score"))
        return search.hybrid(names, scores, ai, n)

    def suggest(self, member_ids: DataFrame, k: int | None = None) -> DataFrame | dict:
        """Sounds like those of a set (id)."""
        if self.vectors is None:
            return {"error": "notReady"}
        members = self.vectors.join(member_ids.select("id").distinct(), "id", "left_semi")
        return similar.suggest(self.vectors, members, clamp(k, SUGGEST))

    def echo(self, pcm, rate: int, before: int = 0, after: int = 0, axes: dict[str, float] | None = None, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame | dict:
        """Where a selection is found in all sounds: samples, with so many of its surroundings before and after it; weights by
        axis; ids (id) that are never returned."""
        if self.prints is None:
            return {"error": "notReady"}
        n = clamp(limit, (1, 500, fingerprints.RESULTS))
        return fingerprints.echo(self.prints, self.summaries, fingerprints.selection(pcm, rate, before, after), weights=fingerprints.axis_weights(**(axes or {})), exclude=exclude, limit=n, keep=n + 30)

    def neighbours(self, ids: DataFrame, k: int = 10, approximate: bool = False) -> DataFrame | dict:
        """The nearest of each id: exactly, or on demand by an index whose recall it measures for itself."""
        if self.vectors is None:
            return {"error": "notReady"}
        q = self.vectors.join(ids.select("id").distinct(), "id", "left_semi")
        return similar.knn_approximate(q, self.vectors, k) if approximate else similar.knn(q, self.vectors, k)


def effective_scope(scope: str, mode: str, offered: list[str]) -> str:
    """The scope of a search: the one asked for if it's offered, else what the mode has by default."""
    return scope if scope != "auto" and scope in offered else "vault" if mode == "vault" else "library"
