"""Change data: snapshot differences, renames, relinking, merging and queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.operators.catalog import ranked

#: The tolerance in ms within which a moved file is the same, and the share that a relink must find.
TOLERANCE, RELINK_SHARE = 2000, 0.30


def diff(before: DataFrame, now: DataFrame, failures: DataFrame | None = None, *, fold_case: bool = False) -> DataFrame:
    """What happened to each path: removed, added, changed or same; a failure at the same time is skipped.

    With fold_case paths that differ only in the case of letters are the same file; `respelled` tells those whose spelling
    has changed, whatever else has, and path is the present one. An empty present listing removes nothing: it says that the
    root couldn't be read.
    """
    some = now.limit(1).agg(F.count("*").alias("some"))
    key = F.lower("path") if fold_case else F.col("path")
    b = before.select(key.alias("_key"), F.col("path").alias("b_path"), F.col("size").alias("b_size"), F.col("mtime").alias("b_mtime"))
    n = now.select(key.alias("_key"), F.col("path").alias("n_path"), F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"))
    joined = b.join(n, "_key", "full_outer").join(F.broadcast(some))  # one row
    joined = joined.withColumns({"path": F.coalesce("n_path", "b_path"), "respelled": F.coalesce(F.col("n_path") != F.col("b_path"), F.lit(False))})
    if failures is not None:
        joined = joined.join(failures.select("path", F.col("mtime").alias("f_mtime")), "path", "left")
    else:
        joined = joined.withColumn("f_mtime", F.lit(None).cast("long"))
    kind = (
        F.when(F.col("n_mtime").isNull() & (F.col("some") == 0), "same")
        .when(F.col("n_mtime").isNull(), "removed")
        .when(F.col("f_mtime") == F.col("n_mtime"), "failed")
        .when(F.col("b_mtime").isNull(), "added")
        .when(F.col("b_mtime") != F.col("n_mtime"), "changed")
        .otherwise("same")
    )
    return joined.select("path", kind.alias("kind"), "respelled", "b_size", "b_mtime", "n_size", "n_mtime")


def rename_pairs(changes: DataFrame) -> DataFrame:
    """Removed and added files whose size and time no other removed or added file has: old, new."""
    gone = changes.where("kind = 'removed'").groupBy(F.col("b_size").alias("size"), F.col("b_mtime").alias("mtime")).agg(F.min("path").alias("old"), F.count("*").alias("n")).where("n = 1").drop("n")
    come = changes.where("kind = 'added'").groupBy(F.col("n_size").alias("size"), F.col("n_mtime").alias("mtime")).agg(F.min("path").alias("new"), F.count("*").alias("n")).where("n = 1").drop("n")
    return gone.join(come, ["size", "mtime"]).select("old", "new")


def relink(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows found again under a new root by relative path, unless both sizes are known and differ: rel, mtime, adopted.

    All of them move. A time that differs within the tolerance is adopted, as file systems keep times less exactly; beyond
    it the row keeps its own, so that the file is looked at again. An unknown size or time is null or 0. Nothing is relinked
    unless RELINK_SHARE of the rows are found.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    met = rows.join(listing.select("rel", F.col("size").alias("l_size"), F.col("mtime").alias("l_mtime")), "rel")
    met = met.where(~(known("size") & known("l_size") & (F.col("size") != F.col("l_size"))))
    away = F.abs(F.col("mtime") - F.col("l_mtime"))
    adopted = known("mtime") & known("l_mtime") & (away > 0) & (away <= TOLERANCE)
    share = met.agg(F.count("*").alias("found")).join(rows.agg(F.count("*").alias("all")))  # two single rows
    moved = met.join(F.broadcast(share)).where((F.col("found") > 0) & (F.col("found") >= RELINK_SHARE * F.col("all")))
    return moved.select("rel", F.when(adopted, F.col("l_mtime")).otherwise(F.col("mtime")).alias("mtime"), F.coalesce(adopted, F.lit(False)).alias("adopted"))


def last_of(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; partial maxima combine before the shuffle."""
    rest = [c for c in changes.columns if c not in (key,)]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in rest))


def merge_queue(jobs: DataFrame) -> DataFrame:
    """One job for each path of requests (path, lane, names, sounds, seq): lanes hi and a ask for a first pass, b for a deep one.

    First passes unite what they ask for and keep the lane of the first of them; they supersede deep ones, before or after.
    Of deep ones alone the last counts.
    """
    first = F.col("lane") != "b"
    asks = lambda c: F.coalesce(F.bool_or(F.when(first, F.col(c))), F.max_by(c, "seq")).alias(c)
    lane = F.coalesce(F.min_by(F.when(first, F.col("lane")), F.when(first, F.col("seq"))), F.lit("b")).alias("lane")
    return jobs.groupBy("path").agg(lane, asks("names"), asks("sounds"))


def upsert(table: DataFrame, news: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of both by key: new values win, except that those of `keep` stay where the new one is null, and the id stays."""
    old = table.select(F.col(key), *(F.col(c).alias(f"o_{c}") for c in table.columns if c != key))
    both = old.join(news, key, "full_outer")
    out: list[Column] = [F.col(key)]
    for c in table.columns:
        if c == key:
            continue
        if c not in news.columns:
            out.append(F.col(f"o_{c}").alias(c))
        elif c in keep:
            out.append(F.coalesce(F.col(c), F.col(f"o_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c))
    return both.withColumn("_new", F.coalesce(F.col("_new"), F.lit(False)) if "_new" in both.columns else F.lit(True)).select(*out)


def write_batch(table: DataFrame, news: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """upsert() in which all rows of one batch get the next generation, a column `gen`; an empty batch raises none."""
    last = table.agg(F.coalesce(F.max("gen"), F.lit(0)).alias("_last"))
    stamped = news.withColumn("_new", F.lit(True)).join(F.broadcast(last)).withColumn("gen", F.col("_last") + 1).drop("_last")  # one row
    return upsert(table, stamped, key, keep)


def remap(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Paths after moves (src, dst) of files or whole folders. The longest matching source wins; prefixes are looked up
    by equality, one for each level of the path, so there is no range join."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.size(parts))
    p = rows.withColumn("prefix", F.explode(F.transform(levels, lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    hit = p.join(moves, p.prefix == moves.src).groupBy("path").agg(F.max_by(F.struct("src", "dst"), F.length("src")).alias("m"))
    out = rows.join(hit, "path", "left")
    return out.withColumn("new_path", F.when(F.col("m").isNotNull(), F.concat("m.dst", F.expr("substring(path, length(m.src) + 1)"))).otherwise(F.col("path"))).drop("m")


def attempts(failures: DataFrame, news: DataFrame) -> DataFrame:
    """Failure rows with attempts counted on: from one again where the file has changed since."""
    o = failures.select("path", F.col("mtime").alias("o_mtime"), F.col("attempts").alias("o_attempts"))
    both = o.join(news, "path", "full_outer")
    n = F.when(F.col("mtime").isNull(), F.col("o_attempts")).when(F.col("mtime") == F.col("o_mtime"), F.col("o_attempts") + 1).otherwise(1)
    return both.select("path", F.coalesce("mtime", "o_mtime").alias("mtime"), n.cast("long").alias("attempts"))


def chunked(jobs: DataFrame, size: int) -> DataFrame:
    """Chunks of at most `size` jobs of one lane, in path order. Lanes are few and long, so places are those of the whole queue,
    which no task sorts alone, less those of the lanes before. Paths may repeat: places are given to the jobs themselves."""
    whole = jobs.select(F.struct(*jobs.columns).alias("id"))
    places = ranked(whole, F.col("id.lane"), F.col("id.path"))
    counts = jobs.groupBy("lane").agg(F.count("*").alias("_n"))  # a row a lane
    starts = counts.select(F.col("lane").alias("_lane"), (F.sum("_n").over(Window.orderBy("lane")) - F.col("_n")).alias("_start"))
    placed = places.join(F.broadcast(starts), F.col("id.lane") == F.col("_lane"))
    return placed.select("id.*", F.floor((F.col("rank") - F.col("_start")) / size).alias("chunk"))


def accepted(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results (path, token, seq) that answer the job in flight, the last one asked for (jobs: path, token): an older token
    has been superseded. The first answer takes the job away, so later ones with its token are too late."""
    last = jobs.groupBy("path").agg(F.max("token").alias("token"))
    rest = [c for c in results.columns if c not in ("path", "token")]
    first = results.groupBy("path", "token").agg(F.min_by(F.struct(*rest), "seq").alias("_b")).select("path", "token", "_b.*")
    return first.join(last, ["path", "token"], "left_semi")


def after_crash(crashes: DataFrame) -> DataFrame:
    """What follows each crash (path, seq) of a worker: a file is tried again once, then it's a failure."""
    first = crashes.groupBy("path").agg(F.min("seq").alias("first"))
    return crashes.join(first, "path").select("path", "seq", F.when(F.col("seq") == F.col("first"), "retry").otherwise("failed").alias("state"))


def bump(meta: DataFrame, key: str = "gen") -> DataFrame:
    """A table of (key, value) with one counter raised by one."""
    return meta.withColumn("value", F.when(F.col("key") == key, (F.coalesce(F.col("value").cast("long"), F.lit(0)) + 1).cast("string")).otherwise(F.col("value")))


def update_where(table: DataFrame, news: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Rows whose `on` columns equal those of a row of news take its `columns`, where these aren't null; others stay."""
    n = news.select(*on, *(F.col(c).alias(f"_n_{c}") for c in columns)).dropDuplicates(on)
    joined = table.join(n, on, "left")
    return joined.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def insert(table: DataFrame, news: DataFrame, key: str, order: str, *, replace: bool) -> DataFrame:
    """Rows of both with one of each key: with `replace` the last of news wins, else what was there, or the first of news."""
    rest = [c for c in table.columns if c != key]
    pick = F.max_by if replace else F.min_by
    both = table.withColumns({"_new": F.lit(0), "_at": F.lit(None).cast("long")}).unionByName(news.select(*table.columns, F.lit(1).alias("_new"), F.col(order).cast("long").alias("_at")))
    return both.groupBy(key).agg(pick(F.struct(*rest), F.struct("_new", "_at")).alias("_b")).select(key, "_b.*").select(*table.columns)


def imported(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """What becomes of files (id, folder, name, size) that are imported into a folder in the order of their ids: id, result.

    `skip` where the folder has a file of that name and size, be it one that came before. Else the name itself if it's
    free, or with the first number from 2 on that neither the listing (folder, name, size) nor another import has.
    """
    place = ["folder", "_base", "_ext"]
    plain = {"_base": F.regexp_replace("name", r"\.[^.]*$", ""), "_ext": F.regexp_extract("name", r"(\.[^.]*)$", 1)}
    there = listing.groupBy(F.col("folder").alias("_folder"), F.col("name").alias("_name")).agg(F.min("size").alias("_size"))
    s = sources.withColumns(plain)
    first = s.groupBy("folder", "name").agg(F.min_by("size", "id").alias("_first_size"), F.min("id").alias("_first"))
    s = s.join(first, ["folder", "name"]).join(there, (F.col("name") == F.col("_name")) & (F.col("folder") == F.col("_folder")), "left")
    holder = F.coalesce("_size", "_first_size")
    own = F.col("_name").isNull() & (F.col("id") == F.col("_first"))
    s = s.withColumn("_skip", ~own & (F.col("size") == holder))
    # Numbers that the listing has taken of each name; 1 is the name itself.
    numbered = listing.select("folder", F.regexp_extract("name", r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$", 1).alias("_base"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("_ext"), F.regexp_extract("name", r" \((\d+)\)(?:\.[^.]*)?$", 1).alias("_no"))
    taken = numbered.withColumn("_no", F.when(F.col("_no") == "", 1).otherwise(F.col("_no").cast("int"))).groupBy(*place).agg(F.sort_array(F.collect_set("_no")).alias("_taken"))
    rank = F.row_number().over(Window.partitionBy("folder", "name", "_skip").orderBy("id"))
    s = s.withColumn("_rank", rank).join(taken, place, "left")
    no = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_rank"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    name = F.when(no == 1, F.col("name")).otherwise(F.concat("_base", F.lit(" ("), no.cast("string"), F.lit(")"), "_ext"))
    return s.select("id", F.when(F.col("_skip"), "skip").otherwise(name).alias("result"))
