"""Operators over file listings: folders, scopes, sorting, validation and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrum.functions.text import fold

#: Folders that a scan leaves out, and names that one system reserves.
IGNORED_DIRS = ["node_modules", ".git", "$recycle.bin", "system volume information"]
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
#: Digits to which numbers inside names are padded for natural order.
PAD = 12


def is_audio(name: Column) -> Column:
    return F.lower(name).endswith(".wav") & ~name.startswith("~$")


def has_ignored_dir(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(IGNORED_DIRS))


def split_path(path: Column) -> list[Column]:
    """name, dir and top level of a path relative to the root."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return [name.alias("name"), folder.alias("dir"), F.split(folder, "/")[0].alias("top_level")]


def in_folder(folder_col: Column, folder: str, recursive: bool = True) -> Column:
    wanted = folder.strip("/").lower()
    here = F.lower(folder_col) == wanted
    return (here | F.lower(folder_col).startswith(wanted + "/")) if recursive and wanted else here if wanted else F.lit(True)


def under_root(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def natural_key(text: Column) -> Column:
    """Orders numbers inside names by value and letters by their base: each run of digits is padded, the rest is in lower
    case and without accents."""
    # Longer runs than PAD come after all others, by length first.
    long = lambda p: F.concat(F.lit(":"), F.lpad(F.length(F.regexp_replace(p, "^0+", "")).cast("string"), PAD, "0"), F.regexp_replace(p, "^0+", ""))
    parts = F.regexp_extract_all(fold(F.lower(text)), F.lit(r"(\d+|\D+)"))
    return F.array_join(F.transform(parts, lambda p: F.when(~p.rlike(r"^\d"), p).when(F.length(F.regexp_replace(p, "^0+", "")) > PAD, long(p)).otherwise(F.lpad(F.regexp_replace(p, "^0+", ""), PAD, "0"))), "")


def resolve(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for an ordered list of paths (pos, path); what isn't found is skipped, the order kept in pos. Neither
    side is broadcast, whatever Spark takes its size to be."""
    return wanted.join(rows.hint("merge"), "path")


def folder_tree(listing: DataFrame) -> DataFrame:
    """For each folder at each depth: path, parent, depth, files in it and below it, files in it alone. Rows: dir."""
    counted = listing.groupBy("dir").agg(F.count("*").alias("n"))  # far fewer rows go up the tree than files
    parts = F.split("dir", "/")
    steps = counted.select("dir", "n", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    up = steps.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("rel"), "depth", "n", "dir")
    tree = up.groupBy("rel", "depth").agg(F.sum("n").alias("files"), F.sum(F.when(F.col("rel") == F.col("dir"), F.col("n")).otherwise(0)).alias("direct"))
    parent = F.when(F.col("depth") > 1, F.regexp_replace("rel", "/[^/]*$", "")).otherwise("")
    return tree.select("rel", parent.alias("parent"), F.col("depth").cast("long").alias("depth"), "files", "direct")


def name_error(name: Column) -> Column:
    """The first thing wrong with a file name, null if nothing is."""
    t = F.trim(name)
    return (
        F.when(name.isNull() | (t == ""), "required")
        .when(t != name, "spaces")
        .when(t.isin(".", ".."), "invalid")
        .when(name.rlike(r'[<>:"/\\|?*]'), "characters")
        .when(name.rlike(r"[. ]$"), "ending")
        .when(name.rlike(RESERVED), "reserved")
        .when(F.length(name) > 200, "long")
    )


def collection_name_error(name: Column) -> Column:
    t = F.trim(name)
    return F.when(name.isNull() | (t == ""), "required").when(t == "__colors", "reserved").when(F.length(t) > 80, "long")


#: Value ranges in which ranks are counted, a power of two; their counts are all that is ordered in one place.
RANK_RANGES = 1024


def _range_of(bounds: Column, key: Column, ranges: int) -> Column:
    """How many of the sorted bounds a key reaches, by halving."""
    halves = F.array(*(F.lit(ranges >> k) for k in range(1, ranges.bit_length())))
    return F.aggregate(halves, F.lit(0), lambda lo, n: F.when(F.get(bounds, lo + n - 1) <= key, lo + n).otherwise(lo))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a distinct whole number, without one task that sorts them all: ranks within
    ranges that quantiles bound, so that they're about equal however values are spread, each range beginning after the rows
    of those before it."""
    shares = [k / RANK_RANGES for k in range(1, RANK_RANGES)]
    bounds = rows.agg(F.percentile_approx(by, shares, 10 * RANK_RANGES).alias("_bounds"))  # one row
    dealt = rows.join(F.broadcast(bounds)).withColumn("_range", _range_of(F.col("_bounds"), F.col(by), RANK_RANGES)).drop("_bounds")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # RANK_RANGES rows at most
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_start", "_own")


#: Ranges of a sorted listing, a power of two, and rows of the sample for each, from which their bounds are taken.
SORT_RANGES, SORT_SAMPLE = 256, 40


def ranked(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rank from 0 and id of every row in ascending order of the keys, which end in a distinct one. Rows are dealt to ranges
    by bounds from a sample; a rank is a range's first plus the place inside it, so no task sorts them all."""
    keyed = rows.select("id", F.struct(*keys).alias("_key"))
    many = SORT_RANGES * SORT_SAMPLE
    every = F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / many)).alias("_every")
    # By a hash, so the sample is the same each time; in a listing under `many` rows it is all of them.
    sample = keyed.join(F.broadcast(rows.agg(every))).where(F.pmod(F.xxhash64("id"), F.col("_every")) == 0)
    tiles = sample.select("_key", F.ntile(SORT_RANGES).over(Window.orderBy("_key")).alias("t"))  # about twice `many` rows at most
    bounds = tiles.groupBy("t").agg(F.min("_key").alias("b")).where("t > 1").agg(F.sort_array(F.collect_list("b")).alias("_bounds"))
    at = _range_of(F.col("_bounds"), F.col("_key"), SORT_RANGES)
    dealt = keyed.join(F.broadcast(bounds)).select("id", "_key", at.alias("_range"))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # SORT_RANGES rows at most
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").select((F.col("_start") + F.col("_own")).cast("long").alias("rank"), "id")


def pack(listing: DataFrame) -> DataFrame:
    """Columns with folders replaced by numbers in order of first use: id order decides."""
    first = listing.groupBy("dir").agg(F.min("id").alias("first"))
    return listing.join(numbered(first, "first", "dir_code").drop("first"), "dir").select("id", "name", "dir_code")


def unique_names(rows: DataFrame, key: str = "name", order: str = "id") -> DataFrame:
    """Names made distinct, ignoring case: the second and later of a name get ' (2)', ' (3)' before the extension."""
    n = F.row_number().over(Window.partitionBy(F.lower(key)).orderBy(order))
    base, ext = F.regexp_replace(key, r"\.[^.]*$", ""), F.regexp_extract(key, r"(\.[^.]*)$", 1)
    return rows.withColumn("unique_name", F.when(n == 1, F.col(key)).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))
