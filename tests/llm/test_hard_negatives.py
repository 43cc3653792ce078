"""Hard negatives against plain loops, and awkward rows."""

import collections
import math

import numpy as np
import pytest

from lodestrum.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id string, asked string"


def plain(rows, k=5, m=5):
    sound = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab in rows if lab is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out, order = [], lambda h: (-h[0], h[1] is None, h[1] or 0, h[2])
    for a, (i, x, lab) in enumerate(sound):
        if i is None or i % 100:
            continue
        hits = [(int(x @ y), j, b, other) for b, (j, y, other) in enumerate(sound) if b != a and len(y) == len(x)]
        for p in sorted((h for h in hits if h[3] == lab), key=order)[:k]:
            good = sorted((h for h in hits if h[3] != lab and 80 * p[0] <= 100 * h[0] <= 100 * p[0]), key=order)[:m]
            out += [(i, p[1], r + 1, h[1], p[0], h[0]) for r, h in enumerate(good)]
    return collections.Counter(out)


def made(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, lab, 1, "i", "a") for i, v, lab in rows], SCHEMA).repartition(parts)


def found(df):
    return collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def vectors(rng, n, d, spread=1.0):
    v = rng.standard_normal((n, d)) + spread * rng.standard_normal(d)
    return np.float32(v / np.linalg.norm(v, axis=1, keepdims=True))


@pytest.mark.parametrize("d,scale,few", [(16, 1, 10**9), (5, 3000, 40)])
def test_same_as_loops(spark, monkeypatch, d, scale, few):
    rng = np.random.default_rng(d)
    monkeypatch.setattr(hn, "BLOCK", few)  # one block of anchors, or many
    v = vectors(rng, 900, d) * scale
    rows = [(10 * i, [float(c) for c in x], int(lab)) for i, (x, lab) in enumerate(zip(v, rng.choice(4, 900, p=[0.7, 0.1, 0.1, 0.1]), strict=True))]
    got = found(hn.hard_negatives(made(spark, rows)))
    assert got == plain(rows) and got


def test_ties_and_common_vectors(spark):
    rng = np.random.default_rng(9)
    v = [[float(c) for c in x] for x in vectors(rng, 6, 8)]
    rows = [(i, v[int(rng.integers(6)) if i % 3 else 0], int(i % 2)) for i in range(400)]
    got = found(hn.hard_negatives(made(spark, rows, 7)))
    assert got == plain(rows) and got


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    v = [[float(c) for c in x] for x in vectors(rng, 60, 6)]
    rows = [(50 * i, x, i % 3) for i, x in enumerate(v)]
    rows += [(100, None, 1), (200, v[0], None), (300, [None] + v[1][1:], 0), (400, [float("nan")] + v[1][1:], 0), (500, [float("inf")] + v[1][1:], 0), (600, [], 0), (None, v[3], 1), (None, v[4], 2), (700, v[5][:3], 1), (800, v[6][:3], 1), (900, v[6][:3], 2)]
    rows += [(100, v[2], 0)] * 2
    df = made(spark, rows, 3)
    got, want = found(hn.hard_negatives(df)), plain(rows)
    assert got == want and got
    assert hn.hard_negatives(df.limit(0)).collect() == []
    assert hn.hard_negatives(df.where("vec_id = 150")).collect() == []  # no anchors
    far = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2)]  # a negative positive's score
    assert hn.hard_negatives(made(spark, far)).collect() == []


def test_planes_give_exact_scores_and_drop_most(monkeypatch):
    rng = np.random.default_rng(4)
    x, a = (np.floor(256 * vectors(rng, n, 64, 0.3)).astype(np.int64) for n in (4000, 20))
    exact = a @ x.T
    spans = hn.Spans(np.full((20, 1), hn.LEAST), np.full((20, 1), hn.NO_ID), np.full((20, 1), hn.LEAST), 5)
    i, j, score = hn.surviving(a, hn.Planes(x), np.ones(exact.shape, bool), spans)
    assert (exact[i, j] == score).all()
    for row in range(20):
        assert set(np.argsort(-exact[row], kind="stable")[:5]) <= set(j[i == row])
    assert len(i) < 20 * 30


def test_rows_are_not_shuffled_by_vector(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(10 * i, [float(c) for c in x], i % 2) for i, x in enumerate(vectors(rng, 100, 4))]
    seen = []
    monkeypatch.setattr(hn, "_searched", lambda *a, own=hn._searched: seen.append(own(*a)) or seen[-1])
    hn.hard_negatives(made(spark, rows))
    assert len(seen) == 2
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("x#" not in line for line in plan.splitlines() if "Exchange" in line)
