"""Mixing: targets and selection against plain loops, and awkward rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from lodestrum.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, target double, row string, at long, left string"


def plain(rows, weights=(5, 2, 1), most=3):
    """What mix() gives, as a list of (doc_id, size, source_size, target, copies)."""
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in cut)
        open_ = sum(w[s] for s in order if s not in cut)
        level = left / open_ if open_ else 0.0
        more = {s for s in order if s not in cut and w[s] * level >= most * sizes[s]}
        if not more:
            break
        cut |= more
    target = {s: float(most * sizes[s]) if s in cut else w[s] * level for s in order}
    out = []
    for s in order:
        own = []
        for i, t, _ in (r for r in rows if r[2] == s):
            t = t or ""
            u = (int(hashlib.md5(f"{'' if i is None else i}|11|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            seen = re.sub(r"[\x20\x09-\x0D]", "", t)
            own.append((-math.log(u) / ((sum(c.isalpha() for c in seen) + 1) / (len(seen) + 1)), i, len(WORD.findall(t))))
        whole = min(int(target[s] // sizes[s]), most) if sizes[s] else 0
        left, taken, over = target[s] - whole * sizes[s], set(), None
        order_ = sorted(range(len(own)), key=lambda k: own[k][0])
        for at, k in enumerate(order_):
            if own[k][2] > left:
                over = at
                break
            left -= own[k][2]
            taken.add(k)
        if over is not None:
            best = min(order_[over:], key=lambda k: (abs(own[k][2] - left) if own[k][2] else math.inf, own[k][0]))
            if abs(own[best][2] - left) < left:
                taken.add(best)
        out += [(own[k][1], own[k][2], sizes[s], round(target[s], 6), whole + (k in taken and own[k][2] > 0)) for k in range(len(own))]
    return out


def found(df):
    return [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] if r["size"] else 0) for r in df.collect()]


def same(a, b):
    b = [(*r[:4], r[4] if r[1] else 0) for r in b]
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("seed", [1])
def test_same_as_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {"a": 400, "b": 30, "c": 5, "d": 60, "é": 40, "Z": 3, "": 20, None: 50}
    rows = [(int(i), " ".join(["word", "#x9", "ééé"][k % 3] for k in range(int(rng.pareto(1) * 5) + 1)), s) for s, n in sizes.items() for i in rng.integers(10**6, size=n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    same(found(mixing.mix(df)), plain(rows))
    same(found(mixing.mix(df, weights=(1, 7), most=2)), plain(rows, (1, 7), 2))
    same(found(mixing.mix(df.repartition(2))), plain(rows))


def test_awkward_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", "x"), (None, "a b", "x"), (2, None, "x"), (3, "", "y"), (4, " \n", None), (5, "w " * 50000, None), (6, "z" * 100000, "")]
    df = spark.createDataFrame([(i, t, s, 7, 0.5, "r", 1, "l") for i, t, s in rows], SCHEMA).repartition(3)
    got = found(mixing.mix(df))
    same(got, plain(rows))
    assert mixing.mix(df.limit(0)).collect() == []
    none = mixing.mix(df.where("doc_id in (2, 3)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2
    rows = mixing.mixed_rows(df)
    assert rows.schema.names == df.schema.names
    assert sum(len((r["text"] or "").split()) for r in rows.collect()) == sum(r[1] * r[4] for r in got)


def test_better_documents_come_first(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'a b c d' as text", "if(id < 4000, 's', 't') as source", "if(id % 2 = 0, 4.0, 1.0) as q")
    taken = mixing.mix(df.union(spark.range(8000).selectExpr("id + 10000", "'a b c d'", "'t'", "1.0d")), weights=(1, 5), quality=mixing.F.col("q"))
    counts = {r["good"]: r["n"] for r in taken.where("copies > 0 and doc_id < 4000").selectExpr("doc_id % 2 = 0 as good").groupBy("good").agg(mixing.F.count("*").alias("n")).collect()}
    # Half of the source is taken; of weights 4 and 1, keys under the same end leave 1 - x ** 4 and 1 - x of each half.
    x = min(np.linspace(0, 1, 10001), key=lambda x: abs((1 - x**4 + 1 - x) / 2 - 0.5))
    assert abs(counts[True] / 2000 - (1 - x**4)) < 0.04 and abs(counts[False] / 2000 - (1 - x)) < 0.04
