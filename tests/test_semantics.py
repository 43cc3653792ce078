"""Behaviour in cases that the test tables don't hold."""

import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrum.api import Catalog, effective_scope
from lodestrum.functions import signal
from lodestrum.operators import catalog, changes, edits, search, series, vaults
from lodestrum.sources import legacy, wav


def test_relink_moves_every_file_and_adopts_close_times(spark):
    rows = [("a", 10, 5000), ("b", 10, 5000), ("c", None, 5000), ("d", 10, 5000), ("e", 10, 0), ("f", 10, 5000), ("g", 10, 5000)]
    listing = [("a", 10, 6500), ("b", 10, 9000), ("c", 99, 5000), ("d", 11, 5000), ("e", 10, 7000), ("f", None, 7000), ("x", 1, 1)]
    schema = "rel string, size long, mtime long"
    got = {r["rel"]: (r["mtime"], r["adopted"]) for r in changes.relink(spark.createDataFrame(rows, schema), spark.createDataFrame(listing, schema)).collect()}
    assert got == {"a": (6500, True), "b": (5000, False), "c": (5000, False), "e": (0, False), "f": (7000, True)}


def test_paths_in_other_letters_are_the_same_file(spark):
    before = spark.createDataFrame([("A/x.wav", 1, 1), ("A/y.wav", 1, 1), ("A/z.wav", 1, 1)], "path string, size long, mtime long")
    now = spark.createDataFrame([("a/X.wav", 1, 1), ("a/y.wav", 1, 2), ("A/z.wav", 1, 1)], "path string, size long, mtime long")
    got = {(r["path"], r["kind"], r["respelled"]) for r in changes.diff(before, now, fold_case=True).collect()}
    assert got == {("a/X.wav", "same", True), ("a/y.wav", "changed", True), ("A/z.wav", "same", False)}
    assert {r["kind"] for r in changes.diff(before, now).where("path <> 'A/z.wav'").collect()} == {"added", "removed"}


def test_channels_keep_their_power():
    assert np.allclose(wav.mono(np.ones((3, 4))), 2.0) and np.allclose(wav.mono(np.ones((3, 1))), 1.0) and np.allclose(wav.mono(np.ones((3, 2))), 2**0.5)


def test_wav_formats():
    x = np.array([[2.0], [-2.0], [np.nan], [0.25]])
    assert wav.decode(wav.encode(x, 8000, 32))[1].ravel().tolist() == [2.0, -2.0, 0.0, 0.25]
    whole = wav.decode(wav.encode(x, 8000, 32, floating=False))[1].ravel()
    assert np.allclose(whole, [1, -1, 0, 0.25], atol=1e-9) and wav.read_header(wav.encode(x, 8000, 32, floating=False))["format"] == wav.PCM
    for bits in (8, 16, 24):
        broken = bytearray(wav.encode(x, 8000, 16))
        broken[20], broken[34] = wav.FLOAT, bits  # floats of so few bits aren't any
        assert wav.read_header(bytes(broken)) is None and wav.decode(bytes(broken)) is None


def test_a_root_is_no_pattern(spark, tmp_path):
    root = tmp_path / "lib (1)+x"
    (root / "In").mkdir(parents=True)
    (root / "In" / "a.wav").write_bytes(wav.encode(np.zeros((4, 1)), 8000))
    assert [r["path"] for r in Catalog.of_folder(spark, str(root)).entries.collect()] == ["In/a.wav"]
    assert wav.probe(spark, str(root)) and not wav.probe(spark, str(root) + "-gone")


def test_scopes():
    assert effective_scope("folder", "library", ["auto", "folder"]) == "folder"
    assert effective_scope("folder", "vault", ["auto"]) == "vault" and effective_scope("auto", "library", []) == "library"


def test_listings_ignore_accents_and_count_numbers(spark):
    names = ["b 10", "á 2", "A 10", "ä 9", "B 9", "z 123456789012345", "z 99999999999999"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    assert [r["name"] for r in d.orderBy(catalog.natural_key(F.col("name")), "id").collect()] == ["á 2", "ä 9", "A 10", "B 9", "b 10", "z 99999999999999", "z 123456789012345"]


def test_numbers_of_skewed_values(spark):
    values = [*range(3000), *(10**15 + 7 * k for k in range(50))]
    d = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    assert {r["x"]: r["n"] for r in catalog.numbered(d, "x", "n").collect()} == {v: k for k, v in enumerate(sorted(values))}


def aligned(q, c):
    """Alignment by plain loops: the shorter one over the longer one, its audible frames only."""
    short, long, swapped = (q, c, False) if len(q[0]) <= len(c[0]) else (c, q, True)
    loud = [k for k, on in enumerate(short[1]) if on]
    if not loud:
        return -1.0 * (len(short[0]) / len(long[0]) if swapped else 1), 0
    scores = [sum(float(short[0][k] @ long[0][off + k]) for k in loud) / len(loud) for off in range(len(long[0]) - len(short[0]) + 1)]
    best = max(range(len(scores)), key=lambda o: (round(scores[o], 9), -o))
    return scores[best] * (len(short[0]) / len(long[0]) if swapped else 1), 0 if swapped else best


def test_short_silent_and_long_candidates(spark):
    rng = np.random.default_rng(1)
    raw = {s: np.column_stack([rng.uniform(0.5, 9, n), rng.normal(size=(n, 3))]) for s, n in ((1, 6), (2, 15), (3, 3), (4, 6), (5, 1))}
    raw[4][:, 0] = 0.1  # silent throughout
    f = spark.createDataFrame([(s, w, *map(float, r)) for s, m in raw.items() for w, r in enumerate(m)], "series long, w long, f0 double, f1 double, f2 double, f3 double")
    stats = series.final_stats(series.partial_sums(f))
    known = stats.first()
    mean, spread = (np.array([known[f"{k}{d}"] for d in range(4)]) for k in "mt")
    loud = np.vstack([m[m[:, 0] >= series.QUIET] for m in raw.values() if (m[:, 0] >= series.QUIET).sum() >= 2])
    assert np.allclose(mean, loud.mean(0)) and np.allclose(spread, loud.std(0))

    def unit(m):
        z = (m - mean) / spread
        return z / np.linalg.norm(z, axis=1, keepdims=True), m[:, 0] >= series.QUIET

    rows = series.whole_series(f)
    got = {r["series"]: (r["score"], r["off"]) for r in series.slide(rows.where("series = 1").select("flat"), rows, stats).collect()}
    for s, m in raw.items():
        want = aligned(unit(raw[1]), unit(m))
        assert abs(got[s][0] - want[0]) < 1e-8 and got[s][1] == want[1], s


def test_words_are_looked_for_only_where_they_can_be(spark):
    rows = [(1, "Running Water", "Rivers", "Rivers", 1), (2, "cries of birds", "Animals", "Animals", 2), (3, "Fußschritt", "é", "é", 3), (4, "STORIES", "x", "x", 4), (5, "firewood", "x", "x", 5), (6, "gliding", "Doors", "Doors", 6)]
    d = spark.createDataFrame(rows, "id long, name string, dir string, top_level string, mtime long")
    bare = search.indexed(d)
    kept = bare.withColumnRenamed("top_level", "other")  # without its columns the early test is left out
    for text in ("runs", "running", "cry", "cries", "story", "stories", "wood", "glide", "slide door", "e", "water rivers", "bird animal", "nothing here", "fire water", "doors"):
        a = {(r["id"], r["score"], r["matched"], r["full"]) for r in search.scored(bare, text).collect()}
        assert a == {(r["id"], r["score"], r["matched"], r["full"]) for r in search.scored(kept, text).collect()}, text


def sequential(sources, listing):
    """Imports one after the other."""
    there, out = {(f, n): s for f, n, s in listing}, {}
    for i, folder, name, size in sorted(sources):
        if there.get((folder, name)) == size:
            out[i] = "skip"
            continue
        base, dot, ext = name.rpartition(".")
        k, new = 1, name
        while (folder, new) in there:
            k += 1
            new = f"{base} ({k}){dot}{ext}"
        there[folder, new] = size
        out[i] = new
    return out


def test_imports_as_one_after_the_other(spark):
    rng = np.random.default_rng(4)
    names = ["a.wav", "b.wav"]
    listing = [("f", "a.wav", 1), ("f", "a (2).wav", 5), ("f", "a (4).wav", 6), ("g", "b (2).wav", 1)]
    sources = [(k, "fg"[int(rng.integers(2))], names[int(rng.integers(2))], int(rng.integers(1, 4))) for k in range(40)]
    got = changes.imported(spark.createDataFrame(sources, "id long, folder string, name string, size long"), spark.createDataFrame(listing, "folder string, name string, size long"))
    assert {r["id"]: r["result"] for r in got.collect()} == sequential(sources, listing)


def test_vaults(spark):
    v = spark.createDataFrame([(1, "a", "#111111", True), (2, "b", "#222222", False)], "id long, name string, color string, active boolean")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(vaults.deleted(v, ids(1))) == [(2, "b", "#222222", True)]
    assert rows(vaults.deleted(v, ids(1, 2))) == [(1, "a", "#111111", True)]
    assert rows(vaults.switched(v, ids(9))) == rows(v) and [r[0] for r in rows(vaults.switched(v, ids(2))) if r[3]] == [2]
    news = spark.createDataFrame([(3, "  ", "red"), (4, " n ", "#ABCDEF")], "id long, name string, color string")
    assert rows(vaults.created(v, news))[2:] == [(3, "New Vault", vaults.DEFAULT_COLOR, False), (4, "n", "#ABCDEF", False)]
    patch = spark.createDataFrame([(1, " ", "blue"), (2, "x" * 90, "#00ff00")], "id long, name string, color string")
    assert rows(vaults.updated(v, patch)) == [(1, "a", "#111111", True), (2, "x" * 80, "#00ff00", False)]


def fnv(text):
    out = ""
    for start, prime in edits.LANES:
        h = start
        for c in text.encode():
            h = (h ^ c) * prime % 2**32
        out += f"{h:08x}"
    return out


def test_keys_of_edits(spark):
    numbers = [1.0, -0.0, 0.1 + 0.2, 1e-7, -1.9999996, 120.0, 0.0000005]
    shown = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k long, x double").orderBy("k").select(edits.shown_number(F.col("x"))).collect()]
    assert shown == ["1", "0", "0.3", "0", "-2", "120", "0.000001"]
    texts = ["", "a", '[1,0.3,"power"]', "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").orderBy("k").select(edits.hash_key(F.col("t"))).collect()]
    assert got == [fnv(t) for t in texts]


def test_colours(spark):
    import colorsys

    rng = np.random.default_rng(3)
    rows = [tuple(map(float, x)) for x in rng.uniform(size=(50, 3))] + [(0.5, 0.5, 0.5), (1.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "r double, g double, b double")
    cols = [F.col(c) for c in "rgb"]
    out = d.select(*cols, *(c.alias(n) for c, n in zip(edits.hsl(*cols), "hsl", strict=True)), *(c.alias(f"o{k}") for k, c in enumerate(edits.oklab(*cols))), edits.luminance(*cols).alias("y")).collect()
    for r in out:
        h, light, s = colorsys.rgb_to_hls(r["r"], r["g"], r["b"])
        assert np.allclose([r["h"], r["s"], r["l"]], [h * 360, s, light], atol=1e-9)
    red = out[-1]
    assert np.allclose([red["o0"], red["o1"], red["o2"]], [0.62796, 0.22486, 0.12585], atol=1e-4) and abs(red["y"] - 0.2126) < 1e-9
    assert abs(spark.range(1).select(edits.contrast(F.lit(1.0), F.lit(0.0))).first()[0] - 21) < 1e-9


def test_old_fingerprints(spark):
    rng = np.random.default_rng(5)
    frames = rng.normal(3, 2, (20, legacy.DIMS)).astype("<f4")
    frames[:5, legacy.LOUDNESS] = -20  # silent
    own = ((frames - frames.mean(0)) / frames.std(0)).astype("<f4")
    pack = lambda m: zlib.compress(m.tobytes())
    rows = [("a", 1, 20, 500, pack(frames)), ("b", 1, 20, 500, pack(own)), ("c", 1, 30, 500, pack(frames)), ("d", 1, 20, 500, b"no"), ("e", 1, None, None, None)]
    got = {r["path"]: r for r in legacy.migrate(spark.createDataFrame(rows, "path string, mtime long, windows int, span_ms int, matrix binary")).collect()}
    assert {p: r["state"] for p, r in got.items()} == {"a": "converted", "b": "dropped", "c": "failed", "d": "failed", "e": "failed"}
    a = got["a"]
    assert a["counted"] == 15 and np.allclose(a["sums"][: legacy.DIMS], frames[5:].sum(0), rtol=1e-5) and np.allclose(signal.half_decode(bytes(a["data"])).reshape(20, -1), frames, atol=0.02)
    assert np.allclose(a["attack"], frames[frames[:, legacy.LOUDNESS].argmax()])


def test_old_collections(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"Doors": ["a/b.wav", "c.wav"], "Rain": [], "__colors": {"Doors": "#112233"}}))
    assert [tuple(r) for r in legacy.collections(spark, str(path)).collect()] == [("Doors", 0, "a/b.wav", "#112233"), ("Doors", 1, "c.wav", "#112233")]
    path.write_text("{not json")
    assert legacy.collections(spark, str(path)).collect() == []


def test_category_lists(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = ["Category", "SubCategory", "CatID", "DOORS", "WOOD &amp; CO", "DOORWood", "door, gate ,"]
    rows = ['<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>', '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row>', '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="B3" t="s"><v>4</v></c><c r="C3" t="s"><v>5</v></c><c r="F3" t="s"><v>6</v></c></row>', '<row r="4"><c r="A4" t="s"><v>3</v></c></row>']
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(rows)}</sheetData></worksheet>")
    (tmp_path / "list.xlsx").write_bytes(out.getvalue())
    assert [tuple(r) for r in legacy.categories(spark, str(tmp_path / "list.xlsx")).collect()] == [("DOORS", "WOOD & CO", "DOORWood", "", "", ["door", "gate"])]


def test_mel_bands_by_plain_sums():
    x = np.random.default_rng(6).normal(size=2000)
    got = signal.log_mel(x)
    padded = np.concatenate([x[512:0:-1], x, x[-2:-514:-1]])
    assert got.shape == ((len(padded) - 1024) // 480 + 1, 64)
    frame = padded[480:1504] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1024))
    power = np.array([abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(1024) / 1024))) ** 2 for k in range(513)])
    edges = signal.slaney_hz(np.linspace(signal.slaney(50.0), signal.slaney(14000.0), 66))
    for band in (0, 20, 63):
        lo, mid, hi = edges[band : band + 3]
        total = sum(p * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo) for p, f in zip(power, np.arange(513) * 48000 / 1024, strict=True))
        assert abs(got[1, band] - 10 * np.log10(max(total, 1e-10))) < 1e-6


@pytest.mark.parametrize(("rate", "wanted"), [(44100, 48000), (48000, 44100), (8000, 48000), (48000, 48000)])
def test_other_rates_keep_a_tone(rate, wanted):
    tone = lambda r: np.sin(2 * np.pi * 440 * np.arange(r // 4) / r)
    y = signal.polyphase(tone(rate), rate, wanted)
    assert len(y) == wanted // 4 and np.abs(y[500:-500] - tone(wanted)[500:-500]).max() < 5e-3


def test_labels_of_categories(spark):
    from lodestrum.functions.labels import labelled

    given = [("AIRCRAFT", "HELICOPTER"), ("BOATS", "DOOR"), ("VEHICLES", "DOOR"), ("METAL", "IMPACT"), ("CERAMICS", "BREAK"), ("VEHICLES", "ANTIQUE"), ("RAIN", "INTERIOR"), ("RAIN", "WOOD"), ("RAIN", "GENERAL")]
    given += [("ANIMALS", "CAT WILD"), ("LASERS", "GUN"), ("TOOLS", "HAND"), ("AMBIENCE", "DESERT"), ("AMBIENCE", "MARKET"), ("CROWDS", "MARKET"), ("USER INTERFACE", "CLICK"), ("BEEPS", "CLICK"), ("DIRT & SAND", "TONAL/NOISE")]
    want = ["helicopter", "boat door", "vehicle door", "metal impact", "ceramic break", "antique vehicle", "interior rain", "rain on wood", "rain"]
    want += ["wild cat", "laser gun", "hand tool", "desert", "market ambience", "market crowd", "UI click", "beep click", "dirt and sand tonal or noise"]
    got = {(r["cat"], r["sub"]): r["label"] for r in labelled(spark.createDataFrame(given, "cat string, sub string")).collect()}
    assert got == dict(zip(given, want, strict=True))


def plain_edit(d, a, b, c, f, moved=None):
    """Handles put in order by plain comparisons."""
    d = max(0.0, d)
    m = min(edits.MIN_CROP, d)
    put = lambda x, lo, hi: lo if x < lo else hi if x > hi else x
    if moved == "crop_end":
        b = put(b, m, d)
        a = put(a, 0.0, b - m)
    else:
        a = put(a, 0.0, d - m)
        b = put(b, a + m, d)
    if moved in ("crop_end", "fade_out_start"):
        f = put(f, a, b)
        return d, a, put(c, a, f), f, b
    c = put(c, a, b)
    return d, a, c, put(f, c, b), b


def test_edits_against_plain_rules(spark):
    rng = np.random.default_rng(12)
    rows = [(k, *plain_edit(abs(x[0]), *x[1:5]), float(x[5]), bool(k % 2)) for k, x in enumerate(rng.normal(1.5, 2, (400, 6)).tolist())]
    d = spark.createDataFrame(rows, "k long, duration double, crop_start double, fade_in_end double, fade_out_start double, crop_end double, by double, reverse boolean")
    e = {c: F.col(c) for c in ("duration", *edits.HANDLES, "reverse")}
    order = ("duration", "crop_start", "fade_in_end", "fade_out_start", "crop_end")

    def check(made, plain):
        got = {r["k"]: r for r in d.select("k", *(made[c].alias(c) for c in order)).collect()}
        for k, dd, a, c, f, b, by, back in rows:
            assert np.allclose([got[k][n] for n in order], plain(dd, a, c, f, b, by, back), atol=1e-9), (k, made)

    put = lambda x, lo, hi: lo if x < lo else hi if x > hi else x
    for h, at in (("crop_start", 1), ("crop_end", 4), ("fade_in_end", 2), ("fade_out_start", 3)):
        def moved(dd, a, c, f, b, by, back, h=h, at=at):
            v = [dd, a, c, f, b]
            v[at] = by
            return plain_edit(v[0], v[1], v[4], v[2], v[3], h)

        check(edits.move(e, h, F.col("by")), moved)
    step = lambda s, a, b, c, f, dd: plain_edit(dd, a + s, b + s, c + s, f + s)
    check(edits.slip(e, F.col("by")), lambda dd, a, c, f, b, by, back: step(put(by, -a, dd - b), a, b, c, f, dd))
    check(edits.link(e, "in", F.col("by")), lambda dd, a, c, f, b, by, back: plain_edit(dd, a + (s := put(by, -a, f - c)), b, c + s, f))
    check(edits.link(e, "out", F.col("by")), lambda dd, a, c, f, b, by, back: plain_edit(dd, a, b + (s := put(by, c - f, dd - b)), c, f + s))
    check(edits.reverse(e), lambda dd, a, c, f, b, by, back: plain_edit(dd, dd - b, dd - a, dd - b + c - a, dd - a - (b - f)))
    twice = edits.reverse(edits.reverse(e))
    assert d.where(~edits.equal(e, twice)).count() == 0 and d.where(edits.equal(e, edits.reverse(e))).count() == 0

    def rebased(dd, a, c, f, b, by, back):
        low, high = (dd - b, dd - a) if back else (a, b)
        nd = max(0.0, dd + 0.3 - by)
        low, high = put(5 + low - 5 - by, 0.0, nd), put(5 + high - 5 - by, 0.0, nd)
        if high - low < min(edits.MIN_CROP, nd):
            low, high = 0.0, nd
        x, y = (nd - high, nd - low) if back else (low, high)
        return plain_edit(nd, x, y, x + c - a, y - (b - f))

    check(edits.rebase(e, F.lit(5.0), F.lit(5.0) + F.col("by"), F.lit(5.3) + F.col("duration")), rebased)
    start, end, trimmed = edits.trim(e, F.lit(10.0))
    check(trimmed, lambda dd, a, c, f, b, by, back: plain_edit(b - a, 0.0, b - a, c - a, b - a - (b - f)))
    spans = d.select("k", start.alias("s"), end.alias("e")).collect()
    assert all(abs(r["e"] - r["s"] - (rows[r["k"]][5] - rows[r["k"]][2])) < 1e-9 for r in spans)
    # The greatest gain of an interval is that of many places in it.
    places = [edits.envelope(e, F.col("crop_start") - 0.2 + (F.col("by") + 0.4) * (i / 50)) for i in range(51)]
    for r in d.where("by > 0.1").select(edits.envelope_max(e, F.col("crop_start") - 0.2, F.col("crop_start") + F.col("by") + 0.2).alias("most"), F.greatest(*places).alias("seen")).collect():
        assert r["most"] >= r["seen"] - 1e-9
