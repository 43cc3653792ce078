"""What a review found cut short: whole results against brute force and whole SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from lodestrum.functions import signal
from lodestrum.operators import catalog
from lodestrum.plans import registry

registry.load()
MORE = "/root/testdata/sf0.01"
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_kmeans_reads_every_part(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").selectExpr("* except (p_partkey)", "p_partkey + 19900 as p_partkey")
    part.write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for brand, pdf in part.toPandas().sort_values("p_partkey").groupby("p_brand"):
        pixels = np.stack([pdf["p_size"] * 5.0, pdf["p_retailprice"] % 256, pdf["p_partkey"] % 256], 1)
        want |= {(brand, k): (*c, n) for k, (c, n) in enumerate(signal.palette(pixels, 4))}
    got = {(r["brand"], r["k"]): (r["r"], r["g"], r["b"], r["n"]) for r in registry.QUERIES["agg_kmeans"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[x], want[x]) for x in want)


def whole(name: str, sf: str):
    """What the query's SQL gives; it states the whole job."""
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con.sql(registry.ORACLES[name]).fetchall()


def test_no_sql_states_a_cut_job():
    for name in ("sort_name", "sort_date", "sort_size", "sort_path", "fn_stopwords", "fn_min_chars"):
        assert not any(x in registry.ORACLES[name] for x in ("rank < 200", "substr(text"))
    assert all("limit 250" in registry.ORACLES[name] for name in ("q_echo", "q_echo_coarse", "set_union_cands"))


@pytest.mark.parametrize("name", ["q_echo_coarse", "set_union_cands"])
def test_echo_takes_the_references_candidates(spark, name):
    want = {r[0]: r[1:] for r in whole(name, MORE)}
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES[name](spark, MORE).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(np.allclose(got[s], want[s], atol=2e-6) for s in want)


@pytest.mark.parametrize("name", ["sort_name", "sort_date", "sort_size", "sort_path"])
def test_sorts_rank_the_whole_listing(spark, name):
    got = [tuple(r) for r in registry.QUERIES[name](spark, MORE).select("rank", "id").collect()]
    assert len(got) == 2000 and sorted(got) == sorted(whole(name, MORE))


def test_ranges_of_a_sort_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(catalog, "SORT_SAMPLE", 1)
    names = [f"x {k} {'é' if k % 2 else 'E'}" for k in range(3000)] + ["x 20240101123456", "x 00000000000000007", "x 9999999999999"]
    d = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(4)
    got = [r["id"] for r in catalog.ranked(d, catalog.natural_key(d["name"]), d["id"]).orderBy("rank").collect()]
    assert [int(names[k].split()[1]) for k in got] == sorted(int(n.split()[1]) for n in names)


@pytest.mark.parametrize("name", ["fn_stopwords", "fn_min_chars"])
def test_tokens_of_whole_texts(spark, name):
    assert sorted(map(tuple, registry.QUERIES[name](spark, MORE).collect())) == sorted(whole(name, MORE))


def test_repeats_go_exactly(spark):
    events = spark.read.parquet(f"{MORE}/events.parquet")
    want = {}
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"])):
        want.setdefault((r["user_id"], r["event_type"]), tuple(r))
    got = [tuple(r) for r in registry.QUERIES["str_dedupe"](spark, MORE).collect()]
    assert sorted(got) == sorted(want.values()) and len(got) < events.count()
