"""Queries on tables where files share a path, times have parts of a second, or there are more series than candidates."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.functions import text as tx
from lodestrum.functions.vector import dot, rounded
from lodestrum.operators import concepts, similar
from lodestrum.plans import registry
from tests.test_oracles import DATA, TABLES, rows

registry.load()


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        if (folder / f"{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    return rows(df.toArrow(), cols) == rows(con.sql(registry.ORACLES[name]).to_arrow_table(), cols)


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Parts with keys of seven digits: names hold six of them, so each path is that of ten files."""
    out = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    con.sql(f"copy (select 1000000 + p_partkey // 10 * 100 + p_partkey % 10 as p_partkey, f.* from '{DATA}/part.parquet' p, (select * exclude p_partkey from '{DATA}/part.parquet' where p_partkey = 3) f) to '{out}/part.parquet'")
    con.sql(f"copy (select * from '{DATA}/orders.parquet') to '{out}/orders.parquet'")
    con.sql(f"copy (select * replace (1000000 + l_partkey // 10 * 100 + l_partkey % 10 as l_partkey) from '{DATA}/lineitem.parquet') to '{out}/lineitem.parquet'")
    return out


@pytest.mark.parametrize("name", ["dml_delete", "sort_job_path", "win_preview"])
def test_files_that_share_a_path(spark, copies, name):
    assert same_as_sql(spark, copies, name)


def test_sliding_windows_over_parts_of_a_second(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 5, 59, 59)
    times = [at + dt.timedelta(milliseconds=k) for k in (0, 400, 500, 501, 999, 1500)]
    con = duckdb.connect()
    con.execute("create table e as select unnest(?::timestamp[]) as ts, 'click' as event_type", [times])
    con.sql(f"copy e to '{tmp_path}/events.parquet'")
    assert same_as_sql(spark, tmp_path, "ext_sliding")


def test_echo_among_more_series_than_candidates(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select * replace (event_id % 900 as user_id) from '{DATA.replace('0.001', '0.01')}/events.parquet') to '{tmp_path}/events.parquet'")
    assert same_as_sql(spark, tmp_path, "q_echo")


def test_rounded_to_nothing_keeps_its_sign(spark):
    got = spark.createDataFrame([([-1e-9, 1e-9, -0.25, 0.0],)], "v array<double>").select(rounded(F.col("v")).alias("v")).first()["v"]
    assert list(map(repr, got)) == ["-0.0", "0.0", "-0.25", "0.0"]


def test_words_that_stand_out_by_brute_force(spark, monkeypatch):
    """Blocks of a few words and views, and words that aren't broadcast; the same as z-scores over all pairs."""
    monkeypatch.setattr(concepts, "BLOCK", 16)
    rng = np.random.default_rng(4)
    views = spark.createDataFrame([(k // 2, k % 2, rng.normal(size=6).tolist()) for k in range(60)], "image long, view long, vec array<double>")
    words = spark.createDataFrame([(f"w{k}", rng.normal(size=6).tolist()) for k in range(50)], "term string, qvec array<double>")
    likeness = views.join(words).withColumn("s", dot(F.col("vec"), F.col("qvec"))).drop("vec", "qvec")
    want = {(r["image"], r["term"]): round(r["z"], 9) for r in concepts.z_scores(likeness, "term").where("z >= 1.5").collect()}
    found = concepts.outstanding(views, words, "term", 1.5)
    assert len(want) > 50 and {(r["image"], r["term"]): round(r["z"], 9) for r in found.collect()} == want
    assert concepts.outstanding(views, words.limit(0), "term", 1.5).count() == 0


def test_neighbours_by_tiles(monkeypatch):
    """Tiles smaller than k, vectors that are the same, and candidates held before: as by sorting all."""
    monkeypatch.setattr(similar, "TILE_ROWS", 7)
    monkeypatch.setattr(similar, "TILE_QUERIES", 5)
    rng = np.random.default_rng(5)
    v, ids = rng.normal(size=(12, 4)).repeat(6, 0), rng.permutation(72)
    s = np.where(ids[:, None] == ids[None, :], -np.inf, np.round(v @ v.T, 12))
    want = [[int(i) for _, i in sorted(zip(-row, ids, strict=True))[:9]] for row in s]
    held = similar.best_of(ids, v, ids[:40], v[:40], 9)
    assert similar.best_of(ids, v, ids, v, 9)[1].tolist() == want == similar.best_of(ids, v, ids[40:], v[40:], 9, held)[1].tolist()


def test_terms_of_a_table_are_made_once(spark):
    """The same terms as for one query; the plan splits each text once."""
    texts = ["", "a", "x", "the of", "red doors of the blue Houses", None, "é stone stone", "b c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = tx.term_rows(rows.repartition(2), F.col("text"))
    want = sorted((k, t.word, t.stem, t.bare or "") for k, text in enumerate(texts) for t in tx.query_terms(text or ""))
    assert sorted((r["id"], r["word"], r["stem"], r["bare"] or "") for r in got.collect()) == want
    plan = got.select("id", "word", "bare")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "(ss|us|is)" not in plan


@pytest.mark.parametrize("name", ["filt_resolve", "filt_missing", "win_preview", "q_concept_names"])
def test_no_listing_in_a_tasks_memory(spark, name):
    """The listing is broadcast nowhere, and pairs of concepts and files are grouped nowhere."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and not (name == "q_concept_names" and "keys=[key" in plan.split("BroadcastNestedLoopJoin")[0])
