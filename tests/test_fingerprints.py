"""The search by example from WAV bytes to ranked hits, against plain loops over all 44 numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.functions import signal
from lodestrum.operators import fingerprints as fp
from lodestrum.operators import series
from lodestrum.sources import wav

RATE = signal.RATE


def sound(seed, seconds):
    """Notes and bursts of noise, so that frames differ."""
    r = np.random.default_rng(seed)
    parts = []
    while sum(map(len, parts)) < seconds * RATE:
        t = np.arange(int(RATE * r.uniform(0.05, 0.2))) / RATE
        parts.append(r.uniform(0.05, 0.6) * (np.sin(2 * np.pi * r.uniform(80, 6000) * t) if r.random() < 0.6 else r.uniform(-1, 1, len(t))) * np.exp(-t * r.uniform(0, 20)))
    return np.concatenate(parts)[: int(seconds * RATE)]


@pytest.fixture(scope="module")
def library(spark):
    sounds = {i: sound(i, [0.3, 0.8, 1.5][i % 3]) for i in range(24)}
    sounds[30] = sounds[4].copy()  # a copy
    sounds[31] = np.zeros(RATE // 2)  # silence
    sounds[32] = np.concatenate([np.zeros(RATE // 4), sounds[5][RATE // 8 : RATE // 2]])  # a part of another
    files = spark.createDataFrame([(str(i), wav.encode(x[:, None], RATE)) for i, x in sounds.items()], "path string, content binary").repartition(4)
    decoded = wav.samples(files)
    rows = decoded.select(F.col("path").cast("long").alias("id"), "rate", F.col(decoded.columns[-1]).alias("samples"))
    prints = spark.createDataFrame(fp.fingerprints(rows).toPandas())
    sums = spark.createDataFrame(fp.summaries(prints).toPandas())
    return sounds, prints.repartition(3), sums.repartition(3)


def plain(prints, query, weights, exclude, k):
    """Ids with score and offset by loops over frames, best first; and which were candidates."""
    m = {r["id"]: fp.SPECTRAL.matrix(r["data"]) for r in prints.collect()}
    loud = {i: x[:, 42] >= np.log(1e-4) for i, x in m.items()}
    frames = np.concatenate([x[loud[i]] for i, x in m.items() if loud[i].sum() >= 2])
    mean, spread = frames.mean(0), frames.std(0)
    spread[spread <= 1e-6] = 1

    def unit(v, w=1.0):
        z = (v - mean) / spread * w
        return z / np.linalg.norm(z) if np.linalg.norm(z) else z

    q_loud = query[:, 42] >= np.log(1e-4)
    a, b = unit(query[q_loud].mean(0)), unit(query[query[:, 42].argmax()])
    near = [{i: round(float(unit(x[loud[i]].mean(0)) @ a), 9) if loud[i].any() else 0.0 for i, x in m.items()}, {i: round(float(unit(x[x[:, 42].argmax()]) @ b), 9) for i, x in m.items()}]
    picked = {i for s in near for i in sorted((i for i in s if i not in exclude), key=lambda i: (-s[i], i))[:k]}
    out = []
    for i in picked:
        short, long, own = (query, m[i], q_loud) if len(query) <= len(m[i]) else (m[i], query, loud[i])
        best, off = -1.0, 0
        if own.any():
            scores = [round(np.mean([unit(short[w], weights) @ unit(long[o + w], weights) for w in np.flatnonzero(own)]), 9) for o in range(len(long) - len(short) + 1)]
            best, off = max(scores), int(np.argmax(scores))
        out.append((best * (len(short) / len(long) if len(query) > len(m[i]) else 1), i, off if len(query) <= len(m[i]) else 0))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("axes", [None, {"timbre": 0.2, "brightness": 2.0, "texture": 0.0, "energy": 1.5, "transient": 0.3}])
def test_hits_are_those_of_plain_loops(library, monkeypatch, axes):
    sounds, prints, sums = library
    weights = None if axes is None else np.array(fp.axis_weights(**axes))
    monkeypatch.setattr(fp, "CANDIDATES", 12)
    cut = sounds[5][RATE // 8 : RATE // 2]
    query = fp.selection(sounds[5][: RATE // 2], RATE, before=RATE // 8)
    assert len(query) == max(1, (len(cut) - signal.SIZE) // signal.HOP + 1)
    exclude = prints.where("id = 5").select("id")
    got = fp.echo(prints, sums, query, weights=weights, exclude=exclude, limit=100).collect()
    want = plain(prints, query, 1.0 if weights is None else weights, {5}, 12)
    copies = {c for r in got for c in r["copies"]}
    assert [r["id"] for r in got] == [i for _, i, _ in want if i not in copies]
    by = {i: (s, o) for s, i, o in want}
    for r in got:
        assert abs(r["similarity"] - by[r["id"]][0]) < 1e-6 and r["offset_ms"] == int(by[r["id"]][1] * 25)
    assert got[0]["id"] == 32 and 200 <= got[0]["offset_ms"] <= 300


def test_the_best_are_exact_when_others_are_left(library):
    sounds, prints, sums = library
    stats, query = fp.statistics(sums), fp.selection(sounds[7], RATE)
    every = {r["id"]: r["score"] for r in fp.aligned(prints, query, stats).collect()}
    some = {r["id"]: r["score"] for r in fp.aligned(prints.coalesce(1), query, stats, keep=5).collect()}
    assert some == {i: every[i] for i in sorted(every, key=lambda i: (-every[i], i))[:5]}


def test_copies_and_what_gives_no_result(library, spark):
    sounds, prints, sums = library
    got = fp.echo(prints, sums, fp.selection(sounds[4], RATE)).collect()
    assert got[0]["id"] == 4 and got[0]["copies"] == [30] and got[0]["identical"] and 30 not in {r["id"] for r in got}
    assert fp.echo(prints, sums, fp.selection(np.zeros(RATE), RATE)) == {"error": "silent"}
    assert fp.echo(prints, sums, fp.selection(np.ones(20), RATE)) == {"error": "too-short"}
    assert fp.echo(prints.limit(0), sums.limit(0), fp.selection(sounds[4], RATE)) == {"error": "empty"}
    other = fp.selection(signal.polyphase(sounds[4], RATE, 96000), 96000)
    assert fp.echo(prints, sums, other).first()["id"] == 4


def test_summaries_of_loudness_and_content(library):
    _, prints, sums = library
    rows = {r["id"]: r for r in sums.collect()}
    assert rows[31]["counted"] == 0 and rows[4]["hash"] == rows[30]["hash"] != rows[5]["hash"]
    quiet = [(1, 2, [float(v) for v in [-2.0] * 88]), (2, 2, [float(v) for v in [-2.0] * 42 + [-3.0] + [-2.0] * 45])]
    two = {r["id"]: r["hash"] for r in fp.summaries(prints.sparkSession.createDataFrame(quiet, "id long, frames int, data array<double>")).collect()}
    assert two[1] != two[2]  # they differ in loudness alone


def test_alignment_in_steps_is_that_of_all_places():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for n, m in ((70, 300), (5, 6), (1, 40), (33, 33)):
        q, o, loud = unit(rng.standard_normal((n, 6)) + 1), unit(rng.standard_normal((m, 6)) + 1), rng.random(n) < 0.8
        loud[0] = True
        scores = [round(np.mean([q[w] @ o[p + w] for w in np.flatnonzero(loud)]), 9) for p in range(m - n + 1)]
        assert series.best_alignment(q, loud, o) == (max(scores), int(np.argmax(scores)))
        assert series.best_alignment(q, loud, o, max(scores) - 0.01) == (max(scores), int(np.argmax(scores)))
        assert series.best_alignment(q, loud, o, max(scores) + 0.1)[0] <= max(scores)
