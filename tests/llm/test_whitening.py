"""Whitening against numpy, with and without a spectrum that ends, and awkward rows."""

import numpy as np
import pytest

from lodestrum.llm import whitening


def plain(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    z = (n * u - sums) / n
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), ((n * x - sums) / n) @ q / np.sqrt(e), e / np.trace(v)


def frame(spark, vectors, parts=4):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(parts)


def compared(spark, vectors, k, **how):
    vectors = np.asarray(vectors, np.float32)
    df = frame(spark, vectors)
    n, deviation, want, explained = plain(vectors, k)
    got = whitening.whitened_rows(df, k, **how).collect()
    assert len(got) == len(vectors) * min(k, vectors.shape[1])
    signs = {}
    for r in got:
        i, j = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[j] - 1) < 1e-9
        sign = signs.setdefault(j, np.sign(r["whitened"] * want[i, j]) or 1)
        assert abs(r["whitened"] - sign * want[i, j]) < 1e-7


def test_few_directions_need_no_full_basis(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((600, 5)) * [90, 60, 40, 25, 16] @ np.linalg.qr(rng.standard_normal((40, 5)))[0].T
    w = whitening.fit_whitening(frame(spark, vectors), 4, tolerance=1e-9)
    assert not w.expanded and w.passes < 8
    compared(spark, vectors, 4, tolerance=1e-9)


def test_a_flat_spectrum_is_expanded(spark):
    vectors = np.random.default_rng(2).standard_normal((500, 30))
    w = whitening.fit_whitening(frame(spark, vectors), 16)
    assert w.expanded
    compared(spark, vectors, 16)


def test_many_columns_and_few_dimensions(spark):
    rng = np.random.default_rng(3)
    compared(spark, rng.standard_normal((300, 70)), 16)  # wider than one row of sums
    compared(spark, rng.standard_normal((50, 3)), 16)
    compared(spark, rng.standard_normal((50, 1)), 16)


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in v], "x") for i, v in enumerate(np.float32(rng.standard_normal((40, 4))))]
    odd = [(50, None, "x"), (51, [1.0, None, 2.0, 3.0], "x"), (52, [1.0, float("nan"), 2.0, 3.0], "x"), (53, [float("-inf"), 1.0, 2.0, 3.0], "x"), (54, [], "x"), (55, [1.0, 2.0], "x")]
    schema = "vec_id long, embedding array<float>, whitened string"
    alone = whitening.whitened_rows(spark.createDataFrame(good, schema), 2, seed=5)
    more = good + odd + [(None, good[0][1], "x"), good[1]] + [(100 + i, good[2][1], "x") for i in range(200)]
    got = whitening.whitened_rows(spark.createDataFrame(more, schema).repartition(3), 2, seed=5)
    want = {(r["vec_id"], r["component"]): r for r in alone.collect()}
    rows = got.collect()
    assert len(rows) == 2 * (40 + 2 + 200) and {r["n"] for r in rows} == {40}
    for r in rows:
        w = want[{None: 0}.get(r["vec_id"], r["vec_id"] if r["vec_id"] is not None and r["vec_id"] < 100 else 2) if r["vec_id"] is not None else 0, r["component"]]
        assert w["deviation"] == r["deviation"] and abs(abs(w["whitened"]) - abs(r["whitened"])) < 1e-9
    assert whitening.whitened_rows(spark.createDataFrame(odd[:5], schema)).collect() == []
    assert whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0], "x")] * 9, schema)).collect() == []  # no variance
    line = whitening.whitened_rows(spark.createDataFrame([(i, [float(i), 2.0 * i], "x") for i in range(9)], schema)).collect()
    assert {r["component"] for r in line} == {1}


def test_large_numbers_are_exact(spark):
    df = frame(spark, [[2.0**23, 1.0], [-(2.0**23), 0.5], [3.0, 2.0]])
    x = [[2**29 + 10**6, 64 + 10**6], [-(2**29) + 10**6, 32 + 10**6], [192 + 10**6, 128 + 10**6]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened_rows(df, 1).collect()}
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)}


@pytest.mark.parametrize("n", [5, 2**40])
def test_numerators(n):
    w = whitening.Whitening(n, np.array([7, 9], object), np.zeros((2, 0)), np.zeros(0), np.zeros(0), 0.0, 0, False)
    assert w.numerators(np.array([[3, 4]])).tolist() == [[3 * n - 7, 4 * n - 9]]
