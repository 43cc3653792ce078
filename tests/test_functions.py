import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrum.functions import signal
from lodestrum.functions import text as tx
from lodestrum.functions.translate import translate
from lodestrum.sources import wav


def matches(word, name):
    """Does a one-word query match a name, by the weights' own rules?"""
    (term,) = tx.query_terms(word)
    tokens = [t for t in tx.py_tokens(name)]
    tokens += [tx.py_stem(t) for t in tokens]
    return term.word in tokens or term.stem in tokens or any(a in tokens for a in term.alternates) or any(t.startswith(term.word) or (term.bare and t.startswith(term.bare)) or (len(term.word) >= 4 and term.word in t[3:]) for t in tokens)


def test_words_match_whole_prefix_or_tail_but_not_inside():
    assert not any(matches("rain", x) for x in ("train", "grain", "brain"))
    assert matches("wood", "firewood") and not matches("ice", "voice")
    assert matches("slide", "sliding door") and matches("impact", "IMPT big") and matches("footsteps", "footstep")


@pytest.mark.parametrize("word,want", [("hitting", "hit"), ("glasses", "glass"), ("carries", "carry"), ("speed", "speed"), ("bus", "bus"), ("falling", "fall"), ("k9s", "k9s"), ("doors", "door")])
def test_stem(spark, word, want):
    from pyspark.sql import functions as F

    assert tx.py_stem(word) == want
    assert spark.createDataFrame([(word,)], "w string").select(tx.stem(F.col("w"))).first()[0] == want


def test_translate():
    assert translate("puerta de madera") == ("wood door", True)
    assert translate("golpes fuertes") == ("loud hit", True)
    assert translate("door slam") == ("door slam", False)


# Positive samples are scaled by one less than negative ones, which adds up to one step to the half step of rounding.
@pytest.mark.parametrize("bits,tolerance", [(16, 1.5 / 32768), (24, 1.5 / 8388608), (32, 1e-7)])
def test_wav_round_trip(bits, tolerance):
    x = np.random.default_rng(1).uniform(-1, 1, (500, 2))
    rate, back = wav.decode(wav.encode(x, 44100, bits))
    assert rate == 44100 and np.abs(back - x).max() <= tolerance


def test_wav_header_repairs_and_refuses():
    data = wav.encode(np.zeros((100, 1)), 8000)
    assert wav.read_header(data)["frames"] == 100
    assert wav.read_header(data[:-50])["frames"] == 75
    assert wav.read_header(b"RIFF....WAVE") is None and wav.read_header(b"") is None
    broken = bytearray(data)
    struct.pack_into("<H", broken, 20, 85)
    assert wav.read_header(bytes(broken)) is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), max_size=50))
def test_half_floats(values):
    back = signal.half_decode(signal.half_encode(np.array(values)))
    clipped = np.clip(values, -signal.F16_MAX, signal.F16_MAX)
    assert len(back) == len(values) and np.all(np.abs(back - clipped) <= np.abs(clipped) * 1e-3 + 1e-7)


def test_features_and_resampling():
    t = np.arange(48000) / 48000
    tone = np.sin(2 * np.pi * 1000 * t)
    f = signal.frame_features(tone)
    assert f.shape[1] == 44 and abs(f[5, 39] * 24000 - 1000) < 60
    half = signal.resample(tone, 2.0)
    assert len(half) == 24000 and np.abs(half[200:-200] - tone[::2][200:-200]).max() < 1e-2
    assert len(signal.resample(np.zeros(0), 1.5)) == 0


def test_palette_is_deterministic():
    p = np.vstack([np.tile([10, 10, 10], (50, 1)), np.tile([200, 0, 0], (30, 1)), [[0, 255, 0]]])
    found = signal.palette(p, 3)
    assert [n for _, n in found] == [50, 30] and found[0][0].tolist() == [10, 10, 10]


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    for name in ("a/x.wav", "a/Y.WAV", "a/.git/z.wav", "a/~$t.wav", "a/n.txt"):
        (tmp_path / name).write_bytes(wav.encode(np.zeros((10, 2)), 48000))
    (tmp_path / "a" / "bad.wav").write_bytes(b"RIFF0000WAVEjunk")
    assert sorted(r["name"] for r in wav.scan(spark, str(tmp_path)).collect()) == ["Y.WAV", "bad.wav", "x.wav"]
    heads = {r["path"].rsplit("/", 1)[1]: r["frames"] for r in wav.headers(wav.contents(spark, str(tmp_path))).collect()}
    assert heads["x.wav"] == 10 and heads["bad.wav"] is None
    got = {r["path"].rsplit("/", 1)[1]: r["samples"] for r in wav.samples(wav.contents(spark, str(tmp_path))).collect()}
    assert got["x.wav"] == [0.0] * 10 and got["bad.wav"] is None
