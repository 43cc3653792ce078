"""Awkward rows in every text operator: nulls, empty and long texts, ties, repeats, clashing columns; and brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.llm import bpe, common, exact_dedup, near_dedup, packing, quality_cnn, quality_rules, sharding, token_counts, toxicity
from lodestrum.llm.queries import vocabulary

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=300):
    return " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in rng.integers(words, size=n).tolist())


ROWS = [(1, "one two three"), (1, "one two three"), (1, "other words"), (None, "one two three"), (None, None), (None, None), (2, ""), (3, " \n"), (4, "word " * 30000), (5, "x" * 100000)]
CLASH = "doc_id long, text string, kept boolean, score double, digest string, salt int, _row long, _kept_id long, rank int, words string, n_words int, _alive int, id string, component_id long"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, True, 0.5, "d", 1, 2, 3, 4, "w", 5, 6, "i", 7) for r in ROWS], CLASH).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 1), (4, 0, 0), (5, 1, 0), (5, 0, 0), (None, 1, 1), (2, None, None)]  # 5 contradicts itself on quality
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda d, _: exact_dedup.exact_groups(d),
    "rules": lambda d, _: quality_rules.quality_rules(d),
    "bpe": lambda d, _: bpe.encode_digests(d, BYTES),
    "toxicity": toxicity.toxicity_scores,
    "tokens": lambda d, _: token_counts.token_counts(d, PIECES),
    "shards": lambda d, _: sharding.ring_shards(d),
    "cnn": quality_cnn.quality_scores,
    "near": lambda d, _: near_dedup.near_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(awkward, labels, name):
    out = OPERATORS[name](awkward, labels).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, _ in ROWS)
    # Rows that repeat get what their equals get.
    ones = [tuple(r) for r in out if r["doc_id"] == 1]
    if name not in ("exact", "shards"):
        assert max(collections.Counter(ones).values()) >= 2
    assert OPERATORS[name](awkward.limit(0), labels).collect() == []


KEEPERS = {"rules": lambda d, _: quality_rules.keep_good(d), "cnn": quality_cnn.keep_good, "exact": lambda d, _: exact_dedup.keep_first(d), "near": lambda d, _: near_dedup.keep_first(d)}


@pytest.mark.parametrize("name", KEEPERS)
def test_keepers_keep_columns_of_any_name(awkward, labels, name):
    out = KEEPERS[name](awkward, labels)
    assert out.schema == awkward.schema
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert not collections.Counter(rows) - collections.Counter(ROWS)
    if name == "exact":
        assert sorted(map(repr, rows)) == sorted(map(repr, [(1, "one two three"), (1, "other words"), (3, " \n"), (4, ROWS[8][1]), (5, ROWS[9][1])]))
    if name == "near":
        texts = collections.Counter(t for _, t in rows if (t or "").strip())
        assert texts == collections.Counter({"one two three": 1, "other words": 1, ROWS[8][1]: 1, ROWS[9][1]: 1})
        assert sum(not (t or "").strip() for _, t in rows) == 4  # near to nothing
    assert KEEPERS[name](awkward.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["rules", "cnn", "exact", "near"])
def test_ids_under_another_name(spark, labels, name):
    d = spark.createDataFrame([(7, prose(np.random.default_rng(1), 80)), (8, prose(np.random.default_rng(1), 80))], "key long, body string")
    keep = {"rules": lambda: quality_rules.keep_good(d, id_col="key", text_col="body"), "cnn": lambda: quality_cnn.keep_good(d, labels.limit(0), id_col="key", text_col="body"), "exact": lambda: exact_dedup.keep_first(d, "key", "body"), "near": lambda: near_dedup.keep_first(d, "key", "body")}[name]
    assert [r["key"] for r in keep().orderBy("key").collect()] == ([7, 8] if name in ("rules", "cnn") else [7])


def test_labels_that_clash_teach_nothing(spark, awkward, labels):
    got, share = common.taught(awkward, labels, "quality", 99991, 99990, 100, lambda sample, share: (sample, share))
    # Of a document with several texts the first teaches; long texts teach whole.
    assert sorted(got) == sorted([("one two three", 1), (ROWS[8][1], 0)]) and share == 0.5
    assert common.taught(awkward.limit(0), labels, "quality", 99991, 99990, 100, lambda *x: x) == ([], 0.5)


def test_salts_hold_a_hot_group(spark):
    d = spark.range(4000).selectExpr("case when id % 3 = 0 then null else 5 end as doc_id", "case when id < 10 then 'a b ' else 'ab' end as text").repartition(16)
    out = exact_dedup.exact_groups(d, salts=4, local_rows=20).collect()
    assert len(out) == 4000 and sum(r["kept"] for r in out) == 1 and {r["group_size"] for r in out} == {4000}
    assert [tuple(r) for r in exact_dedup.keep_first(d, salts=4, local_bytes=500).collect()] == [(5, "a b ")]


def walk(keys, shards, vnodes):
    """The ring key by key: home if there's room, in the order of arcs; then clockwise."""
    places, owners = sharding.ring(shards, vnodes)
    arcs = np.searchsorted(places, keys) % len(places)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out, over = collections.Counter(), []
    for arc in sorted(arcs.tolist()):
        shard = int(owners[arc])
        if room[shard]:
            room[shard] -= 1
            out[arc, shard] += 1
        else:
            over.append(arc)
    for arc in over:
        at = arc
        while not room[int(owners[at := (at + 1) % len(places)])]:
            pass
        room[int(owners[at])] -= 1
        out[arc, int(owners[at])] += 1
    return arcs, out


def test_ring_against_a_walk_of_each_key(spark):
    import hashlib

    ids = [*range(500), *[7] * 400]
    keys = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[: sharding.RING_HEX], 16) for i in ids])
    arcs, want = walk(keys, 9, 8)
    arc_of = dict(zip(ids, arcs.tolist(), strict=True))
    d = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(7)
    out = sharding.ring_shards(d, 9, 8).collect()
    assert collections.Counter((arc_of[r["doc_id"]], r["shard"]) for r in out) == want
    assert len({(r["shard"], r["slot"]) for r in out}) == len(ids)


def test_scores_of_the_network_by_plain_loops():
    net = quality_cnn.ByteCNN(3)
    net.bias[:] = np.linspace(-0.2, 0.2, quality_cnn.FILTERS)
    net.freeze()
    for data in (b"", b"abc", b"some bytes, a few more than a window", bytes(range(256)) * 3):
        a = list(data + bytes(max(0, quality_cnn.WIDTH - len(data))))
        values = [[sum(float(net.table[k][a[at + k]][f]) for k in range(quality_cnn.WIDTH)) + float(net.bias[f]) for f in range(quality_cnn.FILTERS)] for at in range(len(a) - quality_cnn.WIDTH + 1)]
        most = [max(0.0, max(v[f] for v in values)) for f in range(quality_cnn.FILTERS)]
        z = sum(x * float(w) for x, w in zip(most, net.top, strict=True)) + float(net.out)
        assert abs(net.score(data) - 1 / (1 + np.exp(-z))) < 1e-4


def test_fit_reads_by_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    sample = [(prose(rng, 60) + (" !!!! " if k % 2 else "") + prose(rng, 60), k % 2) for k in range(40)]
    whole = quality_cnn.train(sample, epochs=2)
    monkeypatch.setattr(quality_cnn, "CHUNK", 50)
    parts = quality_cnn.train(sample, epochs=2)
    assert np.allclose(whole.table, parts.table, atol=1e-3)


def test_posterior_of_the_label_model_by_plain_loops():
    rng = np.random.default_rng(5)
    votes = rng.integers(0, 3, (200, 4)).astype(np.int8)
    m = toxicity.LabelModel().fit(votes, 0.3)
    for row, p in zip(votes[:40], m.posterior(votes)[:40], strict=True):
        odds = 0.3 / 0.7
        for j, v in enumerate(row.tolist()):
            if v != toxicity.ABSTAIN:
                odds *= (m.table[0, j, v] / m.table[1, j, v]) ** m.weights[j]
        assert abs(p - odds / (1 + odds)) < 1e-9


def test_scores_of_the_classifier_by_plain_loops():
    rng = np.random.default_rng(6)
    sample = [(prose(rng, 40) + (" idiot " if k % 3 == 0 else " ") + prose(rng, 5), int(k % 3 == 0)) for k in range(90)]
    m = toxicity.ToxicityModel(sample, 1 / 3)
    for text in ("", "an IDIOT indeed", *[t for t, _ in sample[:10]]):
        words = re.findall(r"[^\W\d_]+", text.lower())
        known = [w for w in set(words) if w in m.lexical]
        z = m.c + sum(m.w[m.lexical[w]] for w in known) / (len(known) + 1) ** 0.5
        for j, v in enumerate(m.voters.votes(text, words).tolist()):
            z += m.v[j] * {toxicity.TOXIC: 1, toxicity.CLEAN: -1, toxicity.ABSTAIN: 0}[v]
        assert abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_pattern_voters_need_no_lexicon():
    voters = toxicity.Voters([])
    at = {n: k for k, n in enumerate(voters.names)}
    says = lambda t: {n for n, k in at.items() if voters.votes(t, toxicity.words_of(t))[k] == toxicity.TOXIC}
    assert says("THEY WERE ALL GONE") == {"shouting"} and says("what??") == {"exclaiming"} and says("you are such a bore") == {"framed"}
    assert says("this sh*t") == {"masked"} and says("nooooo") == {"drawn_out"} and says("a calm text") == set()


@pytest.mark.parametrize("size", [12, 40, 150, 400, 3000])
def test_links_near_the_threshold_are_found(size):
    """Pairs of sets at 75 to 80 hundredths: bands, likelihood and least members let them pass."""
    rng, lost, asked = np.random.default_rng(size), 0, 0
    for k in range(120):
        share = 0.75 + 0.05 * (k % 6) / 5
        common_n = int(np.ceil(size * share))
        extra = size - common_n
        pool = rng.integers(0, 1 << 63, size, np.int64).astype(np.uint64)
        left = int(rng.integers(0, extra + 1))
        a, b = np.concatenate([pool[:common_n], pool[common_n : common_n + left]]), np.concatenate([pool[:common_n], pool[common_n + left :]])
        ra, rb = near_dedup.sketch(a), near_dedup.sketch(b)
        shared = (near_dedup.band_keys(ra[None]) == near_dedup.band_keys(rb[None])).any()
        likely = near_dedup.plausible(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
        small = [np.unique((x & np.uint64(0xFFFFFFFF)).astype("<u4"))[: near_dedup.MEMBERS] for x in (a, b)]
        asked += 1
        lost += not (shared and likely and near_dedup.overlapping(*small, len(a), len(b)))
    assert lost == 0 and asked == 120


def test_confirmation_goes_by_words():
    rng = np.random.default_rng(7)
    sets = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    for k in range(200):
        n = int(rng.integers(0, 9)) if k % 2 else int(rng.integers(5, 400))
        x = [b"%d" % i for i in rng.integers(6 if k % 3 else 10**6, size=n).tolist()]
        y = [*x[: n // 2], *[b"z"] * int(rng.integers(0, 3)), *x[n // 2 :]]
        assert near_dedup.shared_shingles(x, y) == (len(sets(x)), len(sets(y)), len(sets(x) & sets(y)))


def test_without_doubt_nothing_is_left_out(spark):
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"e{i}_{k}" for k, w in enumerate(base))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(d, doubt=None).collect()} == {i: find(i) for i in sets}


def test_packing_of_any_text_in_many_tasks(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rng = np.random.default_rng(9)
    rows = [(1, " " * 1_200_000 + "a"), (2, "\n" * 1_200_000 + "b"), (3, "y" * 1_200_000), (None, None), (4, ""), (4, "")] + [(10 + k, prose(rng, int(rng.integers(1, 300)))) for k in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(60), BYTES, window=512).collect()
    for i, text in rows[:3] + rows[6:]:
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 4 for r in got) == 2
    full, ends = collections.Counter(), collections.defaultdict(list)
    for r in got:
        full[r["sequence_id"]] += r["length"]
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert max(full.values()) == 512 and sum(n < 512 for n in full.values()) <= 1  # one rest for all sixty tasks
    assert all(sum(n for _, n in sorted(x)[:k]) == sorted(x)[k][0] for x in ends.values() for k in range(len(x)))


def test_rules_report_and_reject_alike(spark):
    rng = np.random.default_rng(10)
    texts = [prose(rng, 60), "$ " * 40 + prose(rng, 20), prose(rng, 30).upper(), "a b c d " * 20, "ab!! " * 30, "\n".join(["same line here"] * 9 + [prose(rng, 40)]), "1234 " * 30, "few words", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(d).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality_rules.keep_good(d).collect()} and 0 in kept and not kept & {1, 2, 3, 7, 8}
    plan = quality_rules.keep_good(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stores_go_with_their_scope(spark):
    from pathlib import Path

    with common.scope():
        store = common.Store(spark, "test")
        one = store.put(spark.range(5).toDF("id"), "one")
        two = store.put(one, "two")
        base = Path(store.base.removeprefix("file:"))
        store.drop(one)
        assert two.count() == 5 and len([p for p in base.iterdir() if p.is_dir()]) == 1
    assert not base.exists()


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    good = [(i, prose(rng, 100)) for i in range(30)]
    rows = good + good[:10] + [(None, good[0][1]), (None, prose(rng, 90)), (None, None), (50, ""), (51, None), (0, prose(rng, 90))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, _whole string"
    spark.createDataFrame([(*r, None, None, None, 1, "x") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    starts = collections.Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert starts == collections.Counter([*range(30), 0, None])  # id 0 has two different texts; one row of a null id is new
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_toxicity_is_what_the_labels_mark():
    """Labels may mark the texts that voters take for clean: held-out rows of label 1 must still be ranked first."""
    rng = np.random.default_rng(8)
    rows = [(prose(rng, 30) + (" idiot scum " if k % 3 == 0 else " ") + prose(rng, 5), int(k % 3 != 0)) for k in range(400)]
    m = toxicity.ToxicityModel(rows[:300], 2 / 3)
    scores = [(m.score(t), y) for t, y in rows[300:]]
    assert min(s for s, y in scores if y) > max(s for s, y in scores if not y)


def test_texts_that_are_not_utf8(spark):
    """A string of Spark's may hold any bytes: the classifiers learn from such texts and score them."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("cast(concat(cast('some words of text ' as binary), if(id % 2 = 0, unhex('FF20C3'), cast('idiot' as binary))) as string)").alias("text"))
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert quality_cnn.keep_good(rows, labels, 0.0).count() == 40
    assert toxicity.toxicity_scores(rows, labels).where("score between 0 and 1").count() == 40


def test_a_long_text_takes_little_memory_beside_it():
    import tracemalloc

    net = quality_cnn.train([("good words", 1), ("bad words", 0)], epochs=1).freeze()
    data = bytes(range(256)) * 65536
    tracemalloc.start()
    score = net.score(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score <= 1 and peak < len(data)  # 16 MB
