"""The text operators against brute force, on small hand-made tables with every awkward row."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest

from lodestrum.llm import bpe, components, exact_dedup, html_tree, near_dedup, packing, quality_cnn, quality_rules, sharding, token_counts, toxicity
from lodestrum.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, kept string, size long, rank int, digest string"


def prose(rng, n, words=300):
    return " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in rng.integers(words, size=n).tolist())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, " o n e "), (7, "a  a\x0b a a a a a"), (None, "no id at all"), (None, "no id at all")]
    base = prose(rng, 200)
    rows += [(10, base), (11, base), (12, base + " "), (13, base.upper()), (14, base.replace("waa ", "changed ", 1))]
    rows += [(20 + i, prose(rng, int(rng.integers(3, 400)))) for i in range(40)]
    rows += [(100, prose(rng, 12000)), (101, "x" * 70000), (102, " " * 70000), (103, "<|endoftext|> café 😀 ▁x <s>" * 3), (104, "line\n" * 30), (105, "# * $ % & | < >" * 5)]
    words = base.split()
    for i in range(30):  # near copies of one text, with one to six words changed
        w = list(words)
        for k in rng.choice(len(w), i % 6 + 1, replace=False):
            w[k] = f"z{i}_{k}"
        rows.append((200 + i, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in texts], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect() if r["doc_id"] is not None}


def ident(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: b"%d" % (len(b) % 2)])
def test_exact_groups_compare_contents_not_digests(docs, texts, digest):
    out = exact_dedup.exact_groups(docs, salts=3, digest=digest, local_rows=7).collect()
    assert len(out) == len(texts)
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[ident(t)].append((-len(t or ""), 1 << 62 if i is None else i))
    want = {i: (min(groups[ident(t)])[1], len(groups[ident(t)])) for i, t in texts if i is not None}
    for r in out:
        if r["doc_id"] is not None:
            assert (r["keep_id"], r["group_size"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert sum(r["kept"] for r in out) == len(groups)
    if digest is exact_dedup.sha256:
        assert all(r["text_sha256"] == hashlib.sha256(ident(dict((i, t) for i, t in texts if i)[r["doc_id"]]).encode()).hexdigest() for r in out if r["doc_id"])


def test_quality_counts(docs, texts):
    out = by_id(quality_rules.quality_rules(docs))
    for i, t in texts:
        if i is None:
            continue
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (r["kept"] is False or not r["base_failed"])
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_verdicts_do_not_depend_on_rule_order(docs):
    kept = lambda rules: {i for i, r in by_id(quality_rules.quality_rules(docs, rules)).items() if r["kept"]}
    assert kept(quality_rules.RULES) == kept(tuple(reversed(quality_rules.RULES)))


def test_bpe_is_the_librarys(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    out = by_id(bpe.encode_digests(docs, BYTES))
    for i, x in texts:
        if i is None:
            continue
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = out[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_hard_words():
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(BYTES), bpe.ByteBPE(open(BYTES, "rb").read()), np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeinorstTH 'é0😀\n"), int(rng.integers(1, 30)))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(words)] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
    # Some proposals must fail for the check to mean anything.
    assert any(own.propose(w.encode()) != own.merged(w.encode()) for w in words if w.isalpha())


def test_token_counts(docs, texts):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = by_id(token_counts.token_counts(docs, PIECES, chunk=500, overlap=16))
    for i, t in texts:
        if i is not None:
            n = len(s.encode(t or ""))
            assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)


def test_shards(spark, docs, texts):
    out = sharding.ring_shards(docs, 7, 16).collect()
    assert len(out) == len(texts)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] and r["law"] == "rows" and r["grown_shard"] is None for r in out if r["doc_id"])


def test_growing_the_ring_moves_few_rows(spark):
    d = spark.range(20000).selectExpr("id as doc_id", "'t' as text")
    place = lambda n: {r["doc_id"]: r["shard"] for r in sharding.ring_shards(d, n).collect()}
    a, b = place(40), place(41)
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)  # taking the remainder by the count would move 97 %


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    got = packing.pack(docs.coalesce(1), BYTES, window=256, pool=16).collect()
    per, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append(r)
        if r["doc_id"] is not None:
            per[r["doc_id"]].append(r)
    for i, x in texts:
        if i is None:
            continue
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(per[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    used = []
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        used.append(at)
    assert max(used) <= 256 and sum(u < 256 for u in used) <= 1


def test_best_fill_is_the_best():
    rng = np.random.default_rng(4)
    for _ in range(300):
        counts = collections.Counter(rng.integers(1, 30, int(rng.integers(0, 9))).tolist())
        room = int(rng.integers(0, 80))
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums}
        chosen = packing.best_fill(dict(counts), room)
        assert sum(a * b for a, b in chosen.items()) == max(s for s in sums if s <= room) and all(chosen[k] <= counts[k] for k in chosen)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(docs, texts):
    out = near_dedup.near_groups(docs).collect()
    assert len(out) == len(texts)
    want = brute_components([(i, t) for i, t in texts if i is not None])
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_blocks_of_a_bucket_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(60):  # a chain of edits: neighbours are linked, the ends aren't
        base = list(base)
        base[int(rng.integers(150))] = f"e{i}"
        rows.append((i, " ".join(base)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_sketches_estimate_overlap():
    rng = np.random.default_rng(8)
    for j in (0.5, 0.75, 0.9):
        n = 2000
        common = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n - common, np.int64).astype(np.uint64)
        a, b = near_dedup.sketch(pool[:n]), near_dedup.sketch(pool[n - common :])
        assert abs((a == b).mean() - j) < 0.1
        assert near_dedup.plausible(a[None], b[None], np.array([n]), np.array([n]))[0] or j < 0.75


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def labelled(spark, label, marks, n=360):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        y = int(i % 3 == 0)
        words = prose(rng, int(rng.integers(20, 120))).split()
        if y:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), str(rng.choice(marks)))
        rows.append((i, " ".join(words)))
        labels.append((i, y, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels = labelled(spark, "toxic", ["idiot", "scum", "moron", "grobnik"])
    out = toxicity.toxicity_scores(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_correlated_voters_count_less():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.4
    vote = lambda right: np.where(np.where(rng.random(3000) < right, y, ~y), toxicity.TOXIC, toxicity.CLEAN)
    good, weak = vote(0.9), vote(0.6)
    m = toxicity.LabelModel().fit(np.stack([good, vote(0.85), weak, weak, weak], 1).astype(np.int8), 0.4)
    assert m.weights[2:].max() < m.weights[:2].min()
    assert ((m.posterior(np.stack([good, good, weak, weak, weak], 1).astype(np.int8)) > 0.5) == y).mean() > 0.85


def test_quality_on_held_out_rows(spark, docs, empty):
    rows, labels = labelled(spark, "quality", ["!!!!", "$$$$"])
    out = quality_cnn.quality_scores(rows, labels).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in out if r["held_out"]]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert len(quality_cnn.quality_scores(docs, labels).collect()) == docs.count()
    assert quality_cnn.quality_scores(empty, labels).count() == 0


def test_chunks_cover_the_whole_text(monkeypatch):
    net = quality_cnn.ByteCNN(1).freeze()
    data = np.random.default_rng(0).bytes(5000)
    whole = net.pooled(data)
    monkeypatch.setattr(quality_cnn, "CHUNK", 37)
    parts = net.pooled(data)
    assert np.allclose(whole, parts)
    net.pooled(b"")


def test_pages_with_known_parts(spark):
    model = html_tree.trained()
    maker = html_tree.Maker(1234)
    wrong = leaves = 0
    for _ in range(150):
        page, labels = maker.labelled()
        p, _ = model.marginals(page, html_tree.features(page, model.known))
        here = [i for i, t in enumerate(page.texts) if t is not None]
        leaves += len(here)
        wrong += sum((p[i] >= 0.5) != labels[i] for i in here)
    assert wrong <= 0.01 * leaves
    odd = "<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three, four five.<script>var x='<p>';</script><p>Sixth &copy</article><div class=comments><p>me too, says a reader.</div><footer>end</footer>"
    d = spark.createDataFrame([(1, "u", odd), (2, None, None), (3, "v", ""), (4, "w", "<p")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_tree.main_text(d).collect()}
    assert got[1][0] == "A & B\n\nOne two three, four five.\n\nSixth ©" and got[2] == got[3] == got[4] == ("", 0)


def test_marginals_are_those_of_all_labellings():
    model = html_tree.trained()
    page = html_tree.parse("<article><h1>Title</h1><p>Some text, and more.</p></article><nav><a>x</a></nav>")
    named = html_tree.features(page)
    n = len(page.tags)
    unary = [sum(model.unary.get(f, 0.0) for f in fs) for fs in named]
    mass, total = np.zeros(n), 0.0
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        s = sum(u for u, v in zip(unary, y, strict=True) if v) + sum(model.pair[html_tree.KINDS.get(page.tags[i], html_tree.OTHER)][2 * y[page.parents[i]] + y[i]] for i in range(1, n))
        mass += np.exp(s) * np.array(y)
        total += np.exp(s)
    assert np.allclose(mass / total, model.marginals(page, named)[0])


def test_empty_tables(empty):
    for df in (exact_dedup.exact_groups(empty), quality_rules.quality_rules(empty), bpe.encode_digests(empty, BYTES), token_counts.token_counts(empty, PIECES), sharding.ring_shards(empty), packing.pack(empty, BYTES), near_dedup.near_groups(empty)):
        assert df.count() == 0


def test_pipeline_stages_keep_columns_and_clean_rows(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    good = [(i, prose(rng, 120), "en", "s", 1) for i in range(60)]
    bad = [(100 + i, prose(rng, 100).replace(" ", "$$$ "), "en", "s", 1) for i in range(30)]
    copies = [(200, good[0][1] + " ", "en", "s", 1), (201, good[1][1] + " extra", "en", "s", 1)]
    docs = spark.createDataFrame(good + bad + copies, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
    ids = {r["doc_id"] for r in d.collect()}
    assert not ids & {b[0] for b in bad} and len(ids & set(range(60))) >= 57
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids
    json.dumps(sorted(ids))
