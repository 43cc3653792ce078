"""The stored index of vectors: recall against brute force, changes, and what a search reads."""

import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.operators import similar, vector_index
from lodestrum.operators.vector_index import SPAN, StoredLists
from lodestrum.session import ship
from lodestrum.sources.tables import vectors

DATA = "/root/testdata/sf0.01"


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clustered(spark, n=3000, d=16, groups=30, first=0, seed=3):
    ship(spark)
    rng = np.random.default_rng(seed)
    v = unit(unit(rng.normal(size=(groups, d)))[np.arange(n) % groups] + 0.05 * rng.normal(size=(n, d)))
    return spark.createDataFrame([(first + i, x.tolist(), "clash") for i, x in enumerate(v)], "id long, vec array<double>, list string").repartition(4)


def near(found):
    return {(r["qid"], r["id"]) for r in found.collect()}


def whole(index):
    return index._read("centres", 0).count()


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_recall_on_the_table_of_embeddings(spark, tmp_path):
    ship(spark)
    v = vectors(spark, DATA).select("id", "vec")
    q = v.where("id % 20 = 0")
    want = near(similar.knn(q, v, 10))
    assert len(near(StoredLists.create(v, str(tmp_path / "index")).search(q, 10)) & want) >= 0.95 * len(want)


def test_only_the_lists_asked_for_are_read(spark, tmp_path):
    v = clustered(spark)
    index = StoredLists.create(v, str(tmp_path / "index"))
    assert index._read("lists", 0).select("id").distinct().count() == index._read("lists", 0).count() == 3000
    assert index.setting < whole(index) / 3
    q = v.where("id in (5, 700)")
    want = near(similar.knn(q, v, 10))
    kept = {r["list"] // SPAN for r in index.lists_of(q).collect()}
    plan = index.asked(index.lists_of(q))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [top" in plan.replace("isnotnull(top#", "top#") and "In(list" in plan.replace("Or(EqualTo(list", "In(list").replace("EqualTo(list", "In(list")
    gone = [d for d in Path(tmp_path / "index/lists/g0").glob("top=*") if int(d.name.split("=")[1]) not in kept]
    assert gone
    for d in gone:
        shutil.move(d, tmp_path / d.name)
    assert len(near(StoredLists(spark, str(tmp_path / "index")).search(q, 10)) & want) >= 0.9 * len(want)


def test_changes_by_generation_and_all_lists_equal_brute_force(spark, tmp_path, monkeypatch):
    v = clustered(spark, 600).select("id", "vec")
    index = StoredLists.create(v, str(tmp_path / "index"))
    changed, added = clustered(spark, 40, seed=8).select("id", "vec"), clustered(spark, 50, first=1000, seed=9).select("id", "vec")
    index.put(changed.union(added), v.where("id between 100 and 130").select("id"))
    index.put(v.where("id = 110"))
    now = v.where("id >= 40 and (id not between 100 and 130 or id = 110)").union(changed).union(added)
    again = StoredLists(spark, str(tmp_path / "index"))
    assert again.generations == [0, 1, 2] and again.setting == index.setting
    q = now.where("id % 9 = 2 or id = 110").union(spark.createDataFrame([(-5, v.first()["vec"])], "id long, vec array<double>"))
    rows = lambda found: [(r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in found.orderBy("qid", "rank").collect()]
    want = rows(similar.knn(q, now, 5))
    assert rows(again.search(q, 5, whole(again))) == want
    monkeypatch.setattr(vector_index, "NAMED", 3)  # more lists than are named: all are read and joined
    assert rows(again.search(q, 5, whole(again))) == want


def test_ties_repeats_and_small_tables(spark, tmp_path):
    ship(spark)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, vec array<double>")
    index = StoredLists.create(same, str(tmp_path / "same"))
    assert [r["id"] for r in index.search(same.where("id = 7"), 3).orderBy("rank").collect()] == [0, 1, 2]
    one = StoredLists.create(same.limit(1), str(tmp_path / "one"))
    assert one.search(same.limit(1), 3).count() == 0
    assert one.search(same.limit(0), 3).count() == 0
    none = StoredLists.create(same.limit(0), str(tmp_path / "none"))
    assert none.search(same.where("id = 7"), 3).count() == 0
    StoredLists(spark, str(tmp_path / "none")).put(same)
    assert [r["id"] for r in StoredLists(spark, str(tmp_path / "none")).search(same.where("id = 7"), 3).orderBy("rank").collect()] == [0, 1, 2]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_the_query_finds_what_brute_force_finds(spark):
    from lodestrum.plans import registry

    registry.load()
    v = vectors(spark, DATA)
    found, want = registry.QUERIES["q_knn_stored"](spark, DATA), near(similar.knn(v.where("id % 50 = 0"), v, 10))
    assert len(near(found) & want) >= 0.95 * len(want)
