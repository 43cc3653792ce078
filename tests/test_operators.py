import numpy as np
from pyspark.sql import functions as F

from lodestrum.operators import catalog, changes, edits, search, similar


def test_natural_order_and_unique_names(spark):
    d = spark.createDataFrame([(1, "kick 10.wav"), (2, "Kick 2.wav"), (3, "kick 2.wav")], "id long, name string")
    assert [r["id"] for r in d.orderBy(catalog.natural_key(F.col("name")), "id").collect()] == [2, 3, 1]
    assert {r["unique_name"] for r in catalog.unique_names(d).collect()} == {"kick 10.wav", "Kick 2.wav", "kick 2 (2).wav"}


def test_empty_listing_removes_nothing(spark):
    before = spark.createDataFrame([("a", 1, 1)], "path string, size long, mtime long")
    assert [r["kind"] for r in changes.diff(before, before.limit(0)).collect()] == ["same"]
    assert [r["kind"] for r in changes.diff(before, before).collect()] == ["same"]
    assert [r["kind"] for r in changes.diff(before.limit(0), before).collect()] == ["added"]


def test_ambiguous_renames_are_left_alone(spark):
    before = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 2, 2)], "path string, size long, mtime long")
    now = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "path string, size long, mtime long")
    assert [tuple(r) for r in changes.rename_pairs(changes.diff(before, now)).collect()] == [("a", "x")]


def test_relink_needs_a_share(spark):
    rows = spark.createDataFrame([(f"f{i}", 1, 1000) for i in range(10)], "rel string, size long, mtime long")
    some = lambda n: spark.createDataFrame([(f"f{i}", 1, 2500) for i in range(n)], "rel string, size long, mtime long")
    assert changes.relink(rows, some(2)).count() == 0
    assert changes.relink(rows, some(3)).count() == 3


def test_full_matches_hide_partial_ones(spark):
    rows = [(1, "sword swing", "a", "a", 5), (2, "sword draw", "a", "a", 9), (3, "firewood", "a", "a", 1)]
    d = search.indexed(spark.createDataFrame(rows, "id long, name string, dir string, top_level string, mtime long"))
    assert [r["id"] for r in search.lexical(d, "sword swing").collect()] == [1]
    assert [(r["id"], r["partial"]) for r in search.lexical(d, "sword dragon").collect()] == [(2, True), (1, True)]
    assert [r["id"] for r in search.lexical(d, "wood").collect()] == [3]
    assert search.lexical(d, "x").count() == 0 and search.lexical(d, "").count() == 0


def vectors(spark, n=600, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    v = centres[rng.integers(0, 20, n)] + 0.35 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")


def test_neighbours_are_exact_and_the_index_finds_most(spark):
    v, d = vectors(spark)
    q = d.where("id % 50 = 0")
    near = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    s = v @ v.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, 600, 50) for j in np.argsort(-s[i], kind="stable")[:10]}
    assert near(similar.knn(q, d, 10)) == want
    assert len(near(similar.knn_approximate(q, d, 10)) & want) >= 0.9 * len(want)


def test_diverse_picks_never_repeat_a_sound(spark):
    v, _ = vectors(spark, 40)
    rows = [(1, i, "d", float(1 - i / 100), v[i // 2].tolist()) for i in range(40)]
    got = similar.mmr(spark.createDataFrame(rows, "card long, id long, dir string, score double, vec array<double>"), 10).collect()
    picked = [v[r["id"] // 2] for r in got]
    assert len(got) == 10 and all(a @ b <= 0.985 for k, a in enumerate(picked) for b in picked[:k])


def test_collapse_keeps_rows_without_content_apart(spark):
    d = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (3, None, 3), (4, None, 4)], "id long, h string, r long")
    got = {r["id"]: r["copies"] for r in similar.collapse(d, F.col("h"), F.col("r")).collect()}
    assert got == {2: [1], 3: [], 4: []}


def test_edits_are_ordered_and_stable(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, rng.normal(2, 4, 5))) for _ in range(2000)]
    cols = ["d", "a", "b", "c", "f"]
    n = spark.createDataFrame(rows, "d double, a double, b double, c double, f double").withColumn("d", F.greatest(F.lit(0.0), "d"))
    one = n.withColumns(edits.normalize(*(F.col(c) for c in cols)))
    again = one.withColumns({f"again_{k}": v for k, v in edits.normalize(*(F.col(c) for c in ("d", "crop_start", "crop_end", "fade_in_end", "fade_out_start"))).items()})
    for r in again.collect():
        assert 0 <= r["crop_start"] <= r["fade_in_end"] <= r["fade_out_start"] <= r["crop_end"] <= r["d"] + 1e-12
        assert all(abs(r[k] - r[f"again_{k}"]) < 1e-9 for k in ("crop_start", "crop_end", "fade_in_end", "fade_out_start"))


def test_moves_take_the_longest_folder(spark):
    rows = spark.createDataFrame([("a/b/c.wav",), ("a/x.wav",), ("ab/y.wav",)], "path string")
    moves = spark.createDataFrame([("a", "n"), ("a/b", "m")], "src string, dst string")
    assert {r["path"]: r["new_path"] for r in changes.remap(rows, moves).collect()} == {"a/b/c.wav": "m/c.wav", "a/x.wav": "n/x.wav", "ab/y.wav": "ab/y.wav"}


def brief_by_hand(rows, asked, names, folders, hidden, per_card, most):
    """One brief, rule by rule: cards as (reasons, total, ids of picks), and why other queries came to nothing."""
    from lodestrum.operators import brief as b

    nothing = {q["key"]: "beyond" for q in asked[b.QUERIES :]}
    hidden = set(hidden) | {q["sound"] for q in asked if q["sound"] is not None}
    runs = []
    for at, q in enumerate(asked[: b.QUERIES]):
        options = []
        for v in (q["vec"], q["alt"]):
            if v is None:
                continue
            near = sorted(((round(float(np.dot(rows[i], v)), 12), i) for i in rows), key=lambda x: (-x[0], x[1]))[: b.HITS]
            near = [(s, i) for s, i in near if i not in hidden]
            if not near:
                continue
            top = near[0][0]
            floor = max(0.75, top - 0.15) if q["kind"] == "sound" else max(min(0.3, top - 0.05), top - 0.25)
            scores = {i: s for s, i in near if s >= floor}
            said = {} if q["kind"] == "sound" else {i: e for k, i, e in names if k == q["key"] and i not in hidden and np.dot(rows[i], v) >= floor}
            scores |= {i: float(np.dot(rows[i], v)) + 0.08 for i in said}
            order = sorted(scores, key=lambda i: (-scores[i], i))
            if not order:
                continue
            best = scores[order[0]]
            scaled = [(i, max(0.0, (scores[i] - floor) / (best - floor)) if best > floor else 1.0) for i in order]
            strength = np.mean([s for _, s in scaled[:8]])
            exact = sum(said.values())
            ok = len(order) >= 5 and (q["kind"] == "sound" or exact >= {"word": 3, "concept": 5}[q["kind"]] or strength >= {"word": 0.52, "concept": 0.58}[q["kind"]])
            options.append((ok, strength, v, scaled))
        if not options:
            nothing[q["key"]] = "unheard"
            continue
        ok, strength, v, scaled = max(options, key=lambda o: (o[0], o[1]))
        runs.append({"q": q, "at": at, "good": ok, "strength": strength, "vec": v, "hits": scaled, "weight": q["weight"] * (2 if q["pinned"] else 1)})
    runs.sort(key=lambda r: (-r["weight"], r["at"]))
    cards = []
    for r in runs:
        twin = [c for c in cards if "sound" not in (c[0]["q"]["kind"], r["q"]["kind"]) and np.dot(c[0]["vec"], r["vec"]) > 0.9]
        (twin[0] if twin else cards.append(c := []) or c).append(r)
    stands = [any(r["good"] or r["q"]["pinned"] for r in c) for c in cards]
    home = {}
    for k, c in enumerate(cards):
        for r in c if stands[k] else []:
            for i, s in r["hits"]:
                if i not in home or s * r["weight"] > home[i][0]:
                    home[i] = (s * r["weight"], k)
    done, small = {}, []
    for k, c in enumerate(cards):
        if not stands[k]:
            nothing |= {r["q"]["key"]: "weak" for r in c}
            continue
        pool = {}
        for r in c:
            for i, s in r["hits"]:
                if home[i][1] == k:
                    pool[i] = max(pool.get(i, 0), s * (0.6 + 0.4 * min(1, r["weight"])))
        left, picks, near = sorted(pool, key=lambda i: (-pool[i], i))[:160], [], dict.fromkeys(pool, 0.0)
        while left and len(picks) < per_card:
            i = max(left, key=lambda i: (0.72 * pool[i] - 0.28 * near[i] - 0.06 * sum(folders[j] == folders[i] for j in picks), -left.index(i)))
            left.remove(i)
            if picks and near[i] > 0.985:
                continue
            picks.append(i)
            for j in left:
                near[j] = max(near[j], float(np.dot(rows[i], rows[j])))
        if len(picks) >= 4:
            done[k] = [[r["q"]["key"] for r in c], len(pool), picks]
        else:
            small.append((k, c))
    for k, c in small:
        votes = {}
        for r in c:
            for i, _ in r["hits"][:24]:
                if home[i][1] != k:
                    votes[home[i][1]] = votes.get(home[i][1], 0) + 1
        to = max(votes, key=lambda v: votes[v]) if votes else None
        if to in done:
            done[to][0] += [r["q"]["key"] for r in c]
        else:
            nothing |= {r["q"]["key"]: "few" for r in c}
    value = lambda k: (10 if any(r["q"]["pinned"] for r in cards[k]) else 0) + sum(r["weight"] for r in cards[k]) * (0.5 + cards[k][0]["strength"])
    return [(done[k][0], done[k][1], done[k][2]) for k in sorted(done, key=lambda k: (-value(k), k))[:most]], nothing


def test_cards_of_many_briefs_are_those_by_hand(spark):
    from lodestrum.operators import brief

    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 8))
    v = base[rng.integers(12, size=260)] + 0.35 * rng.standard_normal((260, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = {i: x for i, x in enumerate(v)}
    folders = {i: f"d{i % 3}" for i in rows}
    names, asked, hidden = [], {}, {}
    for n in range(100):
        key = lambda k, n=n: f"{n}:{k}"
        own = []
        for k in range(int(rng.integers(1, 8)) if n else 43):
            kind = ["word", "concept", "sound"][int(rng.integers(3))]
            at = int(rng.integers(260))
            vec = v[at] if rng.random() < 0.8 else -base[int(rng.integers(12))] / 4
            alt = v[int(rng.integers(260))].tolist() if rng.random() < 0.3 else None
            own.append({"brief": n, "place": k, "key": key(k), "title": f"t{k}", "kind": kind, "vec": vec.tolist(), "alt": alt, "weight": round(float(rng.uniform(0.3, 0.9)), 3), "pinned": bool(rng.random() < 0.1), "sound": at if kind == "sound" else None})
            names += [(key(k), int(i), bool(rng.random() < 0.5)) for i in rng.choice(260, int(rng.integers(0, 12)), replace=False)]
        asked[n], hidden[n] = own, [int(i) for i in rng.choice(260, 5, replace=False)]
    table = spark.createDataFrame([tuple(q.values()) for own in asked.values() for q in own], "brief long, place long, key string, title string, kind string, vec array<double>, alt array<double>, weight double, pinned boolean, sound long")
    d = spark.createDataFrame([(i, x.tolist()) for i, x in rows.items()], "id long, vec array<double>")
    cards, nothing = brief.suggest_cards(d, table, spark.createDataFrame(names, "key string, id long, exact boolean"), spark.createDataFrame(list(folders.items()), "id long, dir string"), spark.createDataFrame([(n, i) for n, ids in hidden.items() for i in ids], "brief long, id long"), per_card=10, most=5)
    got, lost = {}, {}
    for r in cards.orderBy("brief", "place").collect():
        got.setdefault(r["brief"], []).append((r["reasons"], r["total"], [p["id"] for p in r["picks"]]))
    for r in nothing.collect():
        lost.setdefault(r["brief"], {})[r["key"]] = r["why"]
    for n in asked:
        want, why = brief_by_hand(rows, asked[n], names, folders, hidden[n], 10, 5)
        assert got.get(n, []) == want and lost.get(n, {}) == why, n
    assert {w for x in lost.values() for w in x.values()} >= {"beyond", "weak"} and sum(map(len, got.values())) > 100


def test_what_a_picture_shows(spark):
    from lodestrum.operators import concepts

    items = {k: {"key": f"k{k}", "label": label, "cat": cat, "sub": sub} for k, (label, cat, sub) in enumerate([("plastic", "PLASTIC", "MISC"), ("plastic break", "PLASTIC", "BREAK"), ("wild cat", "ANIMALS", "CAT WILD"), ("dog", "ANIMALS", "DOG"), ("bird", "ANIMALS", "BIRD"), ("lake", "WATER", "LAKE"), ("bell bird", "BELLS", "BIRD"), ("old", "ARCHIVED", "OLD")])}
    known = spark.createDataFrame([(w,) for w in ("tiger", "tigers", "lakewater", "lake", "polypropylene", "dog", "finch")], "term string")
    found = [(2, "tigers", 8.0), (1, "polypropylene", 7.0), (3, "dog", 6.0), (4, "finch", 5.9), (5, "lakewater", 5.5), (0, None, 4.9), (6, "dogs", 4.0)]
    rows = spark.createDataFrame([(k, *i.values()) for k, i in items.items()], "concept long, key string, label string, cat string, sub string")
    table = spark.createDataFrame([(7, *f) for f in found], "image long, concept long, term string, evidence double")
    got = concepts.shown(concepts.labelled(table, known, rows)).orderBy("place").collect()
    assert [r["key"] for r in got] == ["k2", "k0", "k3", "k5"] and (got[0]["label"], got[0]["score"], got[1]["label"]) == ("tiger", 0.875, "plastic")
    cz = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.6), (1, 5, 1.4), (1, 4, 3.5), (1, 6, 9.0), (1, 7, 9.0)], "image long, concept long, z double")
    tz = spark.createDataFrame([(1, "tiger", 4.2), (1, "animal", 5.0), (1, "lakewater", 6.0), (1, "dog", 3.9)], "image long, term string, z double")
    terms = spark.createDataFrame([("tiger", 2), ("tiger", 3), *[("animal", k) for k in (2, 3, 4, 5)], ("lakewater", 5), ("dog", 3)], "term string, concept long")
    got = {(r["concept"], r["term"], round(r["evidence"], 6)) for r in concepts.candidates(cz, tz, terms, rows).collect()}
    # A general word needs a category that is clearly seen; bells of birds and archives can't be seen.
    assert got == {(2, "tiger", 5.2), (4, "animal", 6.75)}


def test_the_index_finds_neighbours_in_tables_without_structure(spark):
    from pathlib import Path

    import pytest

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test tables")
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as id", "cast(embedding as array<double>) as vec")
    near = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    want = near(similar.knn(d, d, 10))
    assert len(near(similar.knn_approximate(d, d, 10)) & want) >= 0.95 * len(want)


def test_the_index_takes_any_dimension_and_reads_few_lists_of_clusters(spark, tmp_path):
    v, d = vectors(spark, 900, dims=512)
    index = similar.InvertedLists(d)
    q = d.where("id % 50 = 0")
    near = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    want = near(similar.knn(q, d, 10))
    found = near(index.search(q, d, 10))
    assert len(found & want) >= 0.95 * len(want) and index.probes <= index.lists / 2
    index.save(spark, str(tmp_path / "index"))
    assert near(similar.InvertedLists.load(spark, str(tmp_path / "index")).search(q, d, 10)) == found


def test_blocks_lose_no_neighbour(spark, monkeypatch):
    v, d = vectors(spark, 200)
    near = lambda df: sorted((r["qid"], r["id"], r["rank"]) for r in df.collect())
    want = near(similar.knn(d, d, 5))
    listed = d.selectExpr("id", "vec", "id % 3 as list")
    pairs = lambda df: sorted((r["id"], r["other"]) for r in df.collect())
    alike = pairs(similar.similar_pairs(listed, 0.5))
    assert alike == sorted((i, j) for i in range(200) for j in range(i + 1, 200) if i % 3 == j % 3 and v[i] @ v[j] > 0.5)
    monkeypatch.setattr(similar, "BLOCK", 32)
    assert near(similar.knn(d, d, 5)) == want and pairs(similar.similar_pairs(listed, 0.5)) == alike


def test_suggestions_leave_out_what_is_the_same_as_any_member(spark, monkeypatch):
    v, _ = vectors(spark, 120)
    rows = [(i, v[i].tolist()) for i in range(120)] + [(200, v[39].tolist()), (201, v[60].tolist()), (202, v[60].tolist())]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    members = d.where("id < 40")  # 39 isn't among the sampled sixteen
    sample = np.array(similar.spread_sample(members))
    assert np.allclose(sample, v[[k * 40 // 16 for k in range(16)]])
    got = [r["id"] for r in similar.suggest(d, members, 83).collect()]
    assert not set(got) & {*range(40), 200} and len({60, 201, 202} & set(got)) == 1
    middle = v[:40].mean(0) / np.linalg.norm(v[:40].mean(0))
    score = 0.7 * np.maximum((v @ sample.T).max(1), 0) + 0.3 * (v @ middle)
    want = [i for i in np.argsort(-score, kind="stable").tolist() if i >= 40][:10]
    assert [i for i in got if i < 200][:10] == want and similar.suggest(d, members.limit(0), 5).collect() == []
    monkeypatch.setattr(similar, "BLOCK", 32)  # a set that is numbered where it is
    assert np.allclose(similar.spread_sample(members), sample)
