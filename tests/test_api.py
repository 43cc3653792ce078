import numpy as np
import pytest

from lodestrum.api import Catalog
from lodestrum.functions.register import register
from lodestrum.sources import wav
from lodestrum.sources.store import VersionedTable


@pytest.fixture()
def library(spark, tmp_path):
    for name in ("Doors/wood door 10.wav", "Doors/wood door 2.wav", "Rain/heavy rain.wav", "Rain/Deep/train.wav"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(wav.encode(np.zeros((10, 1)), 8000))
    return Catalog.of_folder(spark, str(tmp_path))


def test_listing_and_tree(library):
    assert [r["name"] for r in library.list("doors").collect()] == ["wood door 2.wav", "wood door 10.wav"]
    assert library.list("Rain", recursive=False).count() == 1 and library.list("Rain").count() == 2 and library.list().count() == 4
    assert {(r["rel"], r["files"], r["direct"]) for r in library.tree().collect()} == {("Doors", 2, 2), ("Rain", 2, 1), ("Rain/Deep", 1, 1)}


def test_searching(library):
    names = {r["id"]: r["name"] for r in library.entries.collect()}
    found = lambda q: {names[r["id"]] for r in library.search(q).collect()}
    assert found("rain") == {"heavy rain.wav", "train.wav"}  # the second by its folder; its name alone wouldn't do
    assert found("trains") == {"train.wav"}
    assert found("puerta de madera") == {"wood door 2.wav", "wood door 10.wav"}
    assert library.hybrid("x", None) == {"error": "notReady"}


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select tokens_of('Él CANTÓ, ok') as t").first()["t"] == ["el", "canto", "ok"]
    rows = spark.sql("select d.k, w.word from values (1, 'a b'), (2, 'c') as d(k, x), lateral words_of(d.x) as w order by 1, 2").collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (1, "b"), (2, "c")]
    assert abs(spark.sql("select cutoff_of(0.5) as c").first()["c"] - 0.30) < 1e-12


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, path string, size long")
    t = VersionedTable(spark, str(tmp_path / "t"), df.schema)
    assert t.read().count() == 0 and t.versions() == []
    t.write(df)
    t.merge(spark.createDataFrame([("b", None), ("c", 5)], "path string, size long"), "path", ["size"])
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([(1, "a", 10), (2, "b", 20), (None, "c", 5)], key=str)
    t.write(t.read().where("path <> 'a'"))
    assert t.versions() == [1, 2] and t.read().count() == 2 and t.read(1).count() == 3
