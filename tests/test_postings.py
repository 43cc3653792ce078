"""A search of the stored index gives the rows of a search of the listing, and reads only the postings it asks for."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrum.api import Catalog
from lodestrum.functions import text as tx
from lodestrum.operators import postings, search
from lodestrum.operators.postings import Postings

SCHEMA = "id long, name string, dir string, top_level string, mtime long, size long, path string, token string, weight int"
LONG = "x" * 30000 + "thunder" + "y" * 30000
NAMES = [
    ("Metal Impact 01.wav", "Metal/Hits", "Metal"), ("metallic-hits.wav", "Metal/Hits", "Metal"), ("IMPT heavy.wav", "", ""), ("Glass Breaking.wav", "Glass", "Glass"),
    ("breaks of glass.wav", "Foley/Glass", "Foley"), ("unbreakable.wav", "Foley", "Foley"), ("Ambience Forêt.wav", "Amb", "Amb"), ("amb forest night.wav", "Amb", "Amb"),
    ("WhooshFast2.wav", "Whoosh", "Whoosh"), ("swooshing slow.wav", "Whoosh", "Whoosh"), (None, "Glass", "Glass"), ("", None, None), (f"{LONG}.wav", "Long", "Long"),
    ("a b.wav", "B", "B"), ("door.wav", "Doors/Metal", "Doors"), ("Door Metal.wav", "Doors", "Doors"), ("door.wav", "Doors/Metal", "Doors"), ("lluvia roja.wav", "Weather", "Weather"),
    ("red rain.wav", "Weather", "Weather"), ("straße über.wav", "Ö", "Ö"), ("galoshing.wav", "Shoes", "Shoes"),
]
ASKED = ["impact metal glass", "glass break", "foret amb", "whoosh", "a b", "door metal", "reakable", "thunder", "", "the of", "x" * 40]


def listing(spark, names=NAMES, first=1):
    rows = [(first + k, n, d, t, k % 5, k, f"{d}/{n}", "clash", 1) for k, (n, d, t) in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(index, rows, text, **how):
    got = [tuple(r) for r in index.search(text, **how).orderBy("rank").collect()]
    want = [tuple(r) for r in search.lexical(search.indexed(rows), text, **how).orderBy("rank").collect()]
    assert got == want, text
    return got


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return Postings.create(listing(spark), str(tmp_path_factory.mktemp("names") / "index"))


@pytest.mark.parametrize("text", ASKED)
def test_rows_of_a_search_of_the_listing(spark, index, text):
    same(index, listing(spark), text)


def test_limits_and_whole_matches(spark, index):
    assert len(same(index, listing(spark), "metal", limit=2)) == 2
    same(index, listing(spark), "metal zebra", partial=False)
    assert same(index, listing(spark), "metal zebra")


def test_more_tokens_than_are_named(spark, index, monkeypatch):
    monkeypatch.setattr(postings, "NAMED", 1)
    assert index.inside("reakable") and index.inside("oshing") is None
    assert len(same(index, listing(spark), "oshing")) == 2


def test_changes_by_generation(spark, tmp_path):
    first = listing(spark)
    index = Postings.create(first, str(tmp_path / "index"))
    renamed = listing(spark, [("Thunder metal.wav", "Sky", "Sky"), ("Metal rain.wav", "Sky", "Sky")])
    added = listing(spark, [("metal glass.wav", "New", "New")], 100)
    assert index.put(renamed.union(added), first.where("id = 15").select("id")) == 1
    now = first.where("id not in (1, 2, 15)").union(renamed).union(added)
    for text in ("metal", "impact", "glass metal", "thunder", "door"):
        same(index, now, text)
    index.put(listing(spark, [("Metal third.wav", "", "")], 15), spark.createDataFrame([(1,)], "id long"))
    now = now.where("id <> 1").union(listing(spark, [("Metal third.wav", "", "")], 15))
    again = Postings(spark, str(tmp_path / "index"))
    assert again.generations == [0, 1, 2]
    for text in ("metal", "thunder", "door"):
        same(again, now, text)


def test_a_lost_writer_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = Postings.create(listing(spark), str(tmp_path / "index"))
    with monkeypatch.context() as m:
        m.setattr(index, "_read", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.put(listing(spark, [("metal.wav", "", "")]))
    again = Postings(spark, str(tmp_path / "index"))
    same(again, listing(spark), "metal")
    again.put(listing(spark, [("metal.wav", "", "")], 50))
    same(again, listing(spark).union(listing(spark, [("metal.wav", "", "")], 50)), "metal")


def test_an_empty_table(spark, tmp_path):
    index = Postings.create(listing(spark).limit(0), str(tmp_path / "index"))
    assert index.search("metal").count() == 0 and index.search("").count() == 0
    index.put(listing(spark))
    same(index, listing(spark), "metal")


def test_only_the_postings_asked_for_are_read(spark, tmp_path):
    rows = spark.range(4000).select("id", F.concat_ws(" ", F.lit("sound"), F.substring(F.md5(F.col("id").cast("string")), 1, 6), F.lit("rain")).alias("name"), F.lit("d").alias("dir"), F.lit("d").alias("top_level"), F.col("id").alias("mtime"))
    rows = rows.union(spark.createDataFrame([(5000, "thunder over hills", "d", "d", 1)], "id long, name string, dir string, top_level string, mtime long"))
    whole = Postings.create(rows, str(tmp_path / "index"))
    plan = whole.asked(tx.query_terms("thunder"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") and "StringStartsWith(start,thunder)" in plan and "PushedFilters: []" not in plan
    # With every other directory gone the search still answers.
    kept = whole._cells_of("thunder")
    for d in Path(tmp_path / "index").glob("*/g0/cell=*"):
        if int(d.name.split("=")[1]) not in kept:
            shutil.move(d, tmp_path / f"{d.parent.parent.name}-{d.name}")
    assert len(list(Path(tmp_path / "index/names/g0").glob("cell=*"))) == 1
    assert [r["id"] for r in Postings(spark, str(tmp_path / "index")).search("thunder").collect()] == [5000]


def test_the_catalogue_finds_names_by_the_index(spark, index):
    rows = listing(spark)
    plain, stored = Catalog(rows), Catalog(rows, names=index)
    for text in ("metal", "lluvia roja", "rojo metal"):
        assert [tuple(r) for r in stored.search(text).collect()] == [tuple(r) for r in plain.search(text).collect()]
