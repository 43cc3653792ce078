"""A stored index of names: postings by token, so that a search reads the tokens it asks for and not the listing.

Its tables, by generation: `names` holds the postings, `tails` the places of tokens at which a later part of them begins.

A posting has the first HEAD letters of its token (`start`), the token, the file's id, the best weight of the fields that hold
the token, and name and mtime, by which hits are ordered. Files are cut into directories by the first two letters and sorted by
token inside; a token of any number of files is spread over tasks and files.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrum.functions import text as tx
from lodestrum.operators import search
from lodestrum.operators.generations import Generations

#: Letters of a token by which it is sorted and found; what is found is tested on whole tokens.
HEAD = 32
#: Tokens found by a later part of them that a search names one by one; where there are more, it reads all postings for them.
NAMED = 4096
#: The least length of a word that is looked for inside tokens, and the place from which on (fixed values of match_weight).
INNER, FROM = 4, 4


class Postings(Generations):
    """Rows: id, name, dir, top_level, mtime; other columns are left alone. Nulls count as empty fields, a row without any token
    is never found, ids are taken to be distinct (of repeated rows one is found). An empty table gives an index without hits."""

    TABLES = {
        "names": "start string, token string, id long, weight int, name string, mtime long, cell int",
        "tails": "head string, start string, cell int",
    }

    @classmethod
    def create(cls, rows: DataFrame, path: str, cells: int = 64) -> Postings:
        index = cls._new(rows.sparkSession, path, cells)
        index.put(rows)
        return index

    @property
    def cells(self) -> int:
        return self.setting

    def _cell(self, token: Column) -> Column:
        return F.pmod(F.crc32(F.substring(token, 1, 2)), F.lit(self.cells)).cast("int")

    def _cells_of(self, prefix: str) -> set[int]:
        return {zlib.crc32(prefix[:2].encode()) % self.cells} if len(prefix) > 1 else set(range(self.cells))

    def _write(self, df: DataFrame, table: str, gen: int, *order: str) -> None:
        dealt = df.repartitionByRange("cell", *order).sortWithinPartitions("cell", *order)
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/{table}/g{gen}")

    def put(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """A generation with these files, in place of what the index has of their ids, and without those removed (id)."""
        gen = self._next()
        number = lambda c: F.col(c).cast("long").alias(c)
        held = search.indexed(rows.select(number("id"), "name", "dir", "top_level", number("mtime")))
        fields = {f: F.coalesce(F.col(f"{f}_tokens"), F.array().cast("array<string>")) for f in tx.FIELDS}
        # A token counts in the field that weighs most; fields are in falling order of weight.
        weighed = lambda tokens, w: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(w).alias("weight")))
        parts, before = [], None
        for f, weight in tx.FIELDS.items():
            own = fields[f] if before is None else F.array_except(fields[f], before)
            parts.append(weighed(own, weight))
            before = fields[f] if before is None else F.concat(before, fields[f])
        posted = held.select("id", "name", "mtime", F.explode(F.concat(*parts)).alias("p")).select("id", "name", "mtime", "p.*")
        posted = posted.select(F.substring("token", 1, HEAD).alias("start"), "token", "id", "weight", "name", "mtime", self._cell(F.col("token")).alias("cell"))
        self._write(posted, "names", gen, "start", "token", "id")
        starts = self._read("names", gen).select("token", "start").where(F.length("token") >= FROM + INNER - 1).distinct()
        places = F.explode(F.sequence(F.lit(FROM), F.length("token") - INNER + 1))
        tails = starts.withColumn("at", places).select(F.expr(f"substring(token, at, {HEAD})").alias("head"), "start").distinct()
        self._write(tails.withColumn("cell", self._cell(F.col("head"))), "tails", gen, "head", "start")
        return self._done(gen, rows, removed)

    def inside(self, word: str) -> list[str] | None:
        """Starts of the tokens that hold the word from their fourth letter on; None where there are more than NAMED."""
        if len(word) < INNER:
            return []
        head = word[:HEAD]
        found = self._every("tails").where(F.col("cell").isin(sorted(self._cells_of(head))) & F.col("head").startswith(head))
        starts = [r["start"] for r in found.select("start").distinct().limit(NAMED + 1).collect()]
        return starts if len(starts) <= NAMED else None

    def asked(self, terms: list[tx.Term]) -> DataFrame:
        """The postings that can match a term. Directories and sorted starts are tested by the scan itself."""
        cells, tests = set(), []
        for t in terms:
            inner, whole, begins = self.inside(t.word), {t.word, t.stem, *t.alternates}, {t.word, *([t.bare] if t.bare else [])}
            if inner is None:
                return self._every("names")
            named = {*(w[:HEAD] for w in whole), *inner}
            # A start of one letter is a token of one letter, whose directory is that of the letter alone.
            cells |= {zlib.crc32(s[:2].encode()) % self.cells for s in named}.union(*map(self._cells_of, begins))
            tests += [F.col("start").isin(sorted(named)), *(F.col("start").startswith(b[:HEAD]) for b in sorted(begins))]
        return self._every("names").where(F.col("cell").isin(sorted(cells)) & reduce(or_, tests))

    def scored(self, text: str) -> DataFrame:
        """As search.scored() of the listing: id, name, mtime, score, matched, full."""
        terms = tx.query_terms(text)
        if not terms:
            none = self._every("names").where(F.lit(False))
            return none.select("id", "name", "mtime", F.lit(0).alias("score"), F.lit(0).alias("matched"), F.lit(False).alias("full"))
        posted = self.asked(terms).withColumn("_t", F.array("token"))
        posted = posted.withColumns({f"m{i}": tx.match_weight(t, F.col("_t")) for i, t in enumerate(terms)})
        best = [F.max(F.when(F.col(f"m{i}") > 0, F.col(f"m{i}") + F.col("weight")).otherwise(0)).alias(f"s{i}") for i in range(len(terms))]
        rows = posted.groupBy("id", "gen").agg(*best, F.max("name").alias("name"), F.max("mtime").alias("mtime"))
        each = [F.col(f"s{i}") for i in range(len(terms))]
        rows = rows.withColumns({"score": sum(each, F.lit(0)), "matched": sum(((c > 0).cast("int") for c in each), F.lit(0))})
        return self._live(rows.where(F.col("matched") >= search.needed(terms))).select("id", "name", "mtime", "score", "matched", (F.col("matched") == len(terms)).alias("full"))

    def search(self, text: str, limit: int = 200, partial: bool = True) -> DataFrame:
        """As search.lexical() of the listing, row by row."""
        return search.best_hits(self.scored(text), limit, partial)
