from pathlib import Path

import pytest

from lodestrum.streaming import changes

EVENTS = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not Path(EVENTS).exists(), reason="no test tables")


@pytest.fixture()
def folder(spark, tmp_path):
    spark.read.parquet(EVENTS).repartition(3, "user_id").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_running_stats_equal_the_batch(spark, folder):
    got = drain(changes.running_stats(changes.read_events(spark, folder)), "complete", "stats")
    want = spark.read.parquet(EVENTS).groupBy("user_id").count()
    assert {(r["user_id"], r["n"]) for r in got.collect()} == {(r["user_id"], r["count"]) for r in want.collect()}


def test_repeats_go(spark, folder):
    events = changes.read_events(spark, folder)
    got = drain(changes.without_repeats(events, "60 days").select("event_id"), "append", "once")
    assert got.count() == got.distinct().count() == spark.read.parquet(EVENTS).count()


def test_windows_close(spark, folder):
    got = drain(changes.tumbling(changes.read_events(spark, folder, 10), late="0 seconds"), "update", "days")
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(EVENTS).count()


def test_table_of_last_changes(spark, folder, tmp_path):
    target = str(tmp_path / "table")
    events = changes.read_events(spark, folder).select("user_id", "event_id", "event_type")
    table = changes.LastChanges(spark, target, "user_id long, event_id long, event_type string", "user_id", "event_id")
    q = events.writeStream.foreachBatch(table.apply).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = table.read()
    want = spark.read.parquet(EVENTS).groupBy("user_id").agg({"event_id": "max"})
    assert {(r[0], r[1]) for r in got.select("user_id", "event_id").collect()} == {tuple(r) for r in want.collect()}
    # A batch run again gives the same, a small one touches few parts.
    one = spark.createDataFrame([(got.first()["user_id"], 10**9, "click")], "user_id long, event_id long, event_type string")
    before = {p: es[-1] for p, es in table.versions().items()}
    table.apply(one, 100)
    table.apply(one, 100)
    after = {p: es[-1] for p, es in table.versions().items()}
    assert sum(before[p] != after[p] for p in before) == 1 and table.read().where("event_id = 1000000000").count() == 1
    assert table.read().count() == len({r[0] for r in want.collect()})


def test_watching_a_folder(spark, tmp_path):
    for name in ("a/one.wav", "a/node_modules/two.wav", "three.WAV", "four.mp3", "~$five.wav", "six.wav"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"RIFF")
    own = spark.createDataFrame([(f"file:{tmp_path}/root/six.wav", 1 << 60)], "path string, until long")
    got = drain(changes.watch(spark, str(tmp_path / "root"), own), "append", "seen")
    assert sorted(r["name"] for r in got.collect()) == ["one.wav", "three.WAV"]
