"""Stages of the pipeline on rows that repeat their id or have none: each row has its own verdict."""

from collections import Counter

import numpy as np
import pytest

from lodestrum.llm import exact_dedup, near_dedup, quality_cnn, quality_rules


def prose(seed):
    return " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in np.random.default_rng(seed).integers(300, size=120).tolist())


A, B, C, JUNK = prose(1), prose(2), prose(3), prose(4).replace(" ", "$$$ ")
ROWS = [(1, A), (1, A), (1, A), (1, C), (None, B), (None, B), (None, JUNK), (7, A), (8, JUNK), (None, None), (None, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, source string").repartition(3)


def found(df):
    assert df.columns == ["doc_id", "text", "source"]
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_rules(docs):
    assert found(quality_rules.keep_good(docs)) == Counter([(1, A)] * 3 + [(1, C), (None, B), (None, B), (7, A)])


def test_exact(docs):
    got = found(exact_dedup.keep_first(docs))
    assert len(got) == 5 and set(got.values()) == {1}
    assert {(1, A), (1, C), (None, B)} <= set(got) and (7, A) not in got
    longer = docs.sparkSession.createDataFrame([(5, "a b", "x"), (5, "a  b", "x"), (5, "ab", "x")], docs.schema)
    assert found(exact_dedup.keep_first(longer)) == Counter([(5, "a  b")])


def test_near(docs):
    full = docs.where("text <> ''")
    got = found(near_dedup.keep_first(full))
    # Shingles of the junk are its own, so it stays here, once.
    assert sorted(t for _, t in got.elements()) == sorted([A, B, C, JUNK])
    assert {(1, A), (1, C), (None, B), (8, JUNK)} == set(got)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int")
    scored = quality_cnn.quality_scores(docs.where("doc_id is null or doc_id > 0"), labels)
    texts = sorted({(t or "") for _, t in ROWS})
    own = {t: [r["score"] for r in quality_cnn.quality_scores(docs, labels).collect() if r["doc_id"] == i] for i, t in ((7, A), (8, JUNK))}
    least = sum(v[0] for v in own.values()) / 2
    assert own[A][0] > least > own[JUNK][0] and scored.count() == len(ROWS) and len(texts) == 5
    got = found(quality_cnn.keep_good(docs, labels, least))
    assert got[1, A] == 3 and got[7, A] == 1 and not got[8, JUNK] and not got[None, JUNK]
