"""Edits of a region as columns: handle order, fades, gain and rendering of single samples."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shortest crop in seconds, and the bounds of gain and pitch.
MIN_CROP, GAIN, PITCH = 0.005, (-60.0, 24.0), (-24.0, 24.0)


def clamp(x: Column, lo, hi) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


#: The handles of an edit, in the order that they keep; further keys of an edit are carried along.
HANDLES = ("crop_start", "fade_in_end", "fade_out_start", "crop_end")


def normalize(duration: Column, crop_start: Column, crop_end: Column, fade_in: Column, fade_out: Column, moved: str | None = None) -> dict[str, Column]:
    """Handles in their order, inside the region, with the least crop between them.

    They're put right from left to right, unless the end of the crop or the start of the fade-out is the handle that is being
    moved: that one keeps its place as far as it can, and pushes those before it.
    """
    d = F.greatest(F.lit(0.0), duration)
    least = F.least(F.lit(MIN_CROP), d)
    if moved == "crop_end":
        end = clamp(crop_end, least, d)
        start = clamp(crop_start, 0.0, end - least)
    else:
        start = clamp(crop_start, 0.0, d - least)
        end = clamp(crop_end, start + least, d)
    if moved in ("crop_end", "fade_out_start"):
        out = clamp(fade_out, start, end)
        return {"crop_start": start, "crop_end": end, "fade_in_end": clamp(fade_in, start, out), "fade_out_start": out}
    into = clamp(fade_in, start, end)
    return {"crop_start": start, "crop_end": end, "fade_in_end": into, "fade_out_start": clamp(fade_out, into, end)}


def _with(edit: dict[str, Column], moved: str | None = None, **new: Column) -> dict[str, Column]:
    """The edit with some handles or its duration changed, in order again."""
    e = edit | new
    return e | normalize(e["duration"], e["crop_start"], e["crop_end"], e["fade_in_end"], e["fade_out_start"], moved)


def move(edit: dict[str, Column], handle: str, to: Column) -> dict[str, Column]:
    """One handle moved; it pushes the others."""
    return _with(edit, handle, **{handle: to})


def slip(edit: dict[str, Column], by: Column) -> dict[str, Column]:
    """The kept window with its fades moved over the audio, as far as the region goes."""
    step = clamp(by, -edit["crop_start"], edit["duration"] - edit["crop_end"])
    return _with(edit, **{h: edit[h] + step for h in HANDLES})


def link(edit: dict[str, Column], side: str, by: Column) -> dict[str, Column]:
    """One edge of the crop moved along with its fade, whose length stays; it stops at the other fade."""
    gap = edit["fade_out_start"] - edit["fade_in_end"]
    if side == "in":
        step = clamp(by, -edit["crop_start"], gap)
        return _with(edit, crop_start=edit["crop_start"] + step, fade_in_end=edit["fade_in_end"] + step)
    step = clamp(by, -gap, edit["duration"] - edit["crop_end"])
    return _with(edit, crop_end=edit["crop_end"] + step, fade_out_start=edit["fade_out_start"] + step)


def fades(edit: dict[str, Column]) -> tuple[Column, Column]:
    """Lengths of the fade-in and the fade-out."""
    return edit["fade_in_end"] - edit["crop_start"], edit["crop_end"] - edit["fade_out_start"]


def _framed(edit: dict[str, Column], start: Column, end: Column, **new: Column) -> dict[str, Column]:
    """The edit with another crop and fades of the same lengths."""
    into, out = fades(edit)
    return _with(edit, crop_start=start, crop_end=end, fade_in_end=start + into, fade_out_start=end - out, **new)


def reverse(edit: dict[str, Column]) -> dict[str, Column]:
    """The same audio the other way round: the crop is mirrored, the fades stay at the edges of what is heard."""
    d = edit["duration"]
    return _framed(edit, d - edit["crop_end"], d - edit["crop_start"], reverse=~edit["reverse"])


def source_range(edit: dict[str, Column]) -> tuple[Column, Column]:
    """The kept part in the region's own time."""
    d = edit["duration"]
    return F.when(edit["reverse"], d - edit["crop_end"]).otherwise(edit["crop_start"]), F.when(edit["reverse"], d - edit["crop_start"]).otherwise(edit["crop_end"])


def rebase(edit: dict[str, Column], old_start: Column, new_start: Column, new_end: Column) -> dict[str, Column]:
    """The edit of another region of the file: what was kept stays where it is in the file, as far as the region reaches; if
    nothing of it is left, all of the region is kept."""
    d = F.greatest(F.lit(0.0), new_end - new_start)
    low, high = (clamp(old_start + x - new_start, 0.0, d) for x in source_range(edit))
    none = high - low < F.least(F.lit(MIN_CROP), d)
    low, high = F.when(none, 0.0).otherwise(low), F.when(none, d).otherwise(high)
    back = edit["reverse"]
    return _framed(edit, F.when(back, d - high).otherwise(low), F.when(back, d - low).otherwise(high), duration=d)


def trim(edit: dict[str, Column], start: Column) -> tuple[Column, Column, dict[str, Column]]:
    """The region cut down to what is kept, as its new start and end in the file, and the edit of that region."""
    low, high = source_range(edit)
    d = high - low
    return start + low, start + high, _framed(edit, F.lit(0.0), d, duration=d)


def equal(a: dict[str, Column], b: dict[str, Column], within: float = 1e-9) -> Column:
    """Are two edits the same but for noise in their numbers? Both have the same keys."""
    plain = [a[k] == b[k] if k == "reverse" or k.endswith("shape") else F.abs(a[k] - b[k]) <= within for k in a]
    return reduce(and_, plain)


def envelope(edit: dict[str, Column], at: Column, shapes: tuple[str, str] = ("power", "power"), tensions: tuple[float, float] = (0.0, 0.0)) -> Column:
    """The gain of both fades at a time of the region, 0 outside the crop."""
    into, out = fades(edit)
    rising = F.when((into > 0) & (at < edit["fade_in_end"]), fade_gain((at - edit["crop_start"]) / into, shapes[0], tensions[0])).otherwise(1.0)
    falling = F.when((out > 0) & (at > edit["fade_out_start"]), fade_gain((edit["crop_end"] - at) / out, shapes[1], tensions[1])).otherwise(1.0)
    return F.when((at < edit["crop_start"]) | (at > edit["crop_end"]), 0.0).otherwise(F.least(rising, falling))


def envelope_max(edit: dict[str, Column], start: Column, end: Column, **how) -> Column:
    """The greatest gain between two times: fades are monotonic, so it's at an edge unless there is a part without fades."""
    low, high = F.greatest(start, edit["crop_start"]), F.least(end, edit["crop_end"])
    inside = F.when((low <= edit["fade_out_start"]) & (high >= edit["fade_in_end"]), 1.0).otherwise(F.greatest(envelope(edit, low, **how), envelope(edit, high, **how)))
    return F.when((end < edit["crop_start"]) | (start > edit["crop_end"]), 0.0).otherwise(inside)


def fade_gain(progress: Column, shape: str, tension: float) -> Column:
    """The gain of a fade in at a place in 0..1. Tension bends it: as an exponent of ten to the tension for a power fade and for
    the quarter sine of an equal-power one; an s-curve is the odds of the place raised to twice four to the tension."""
    bend = min(1.0, max(-1.0, tension))
    if shape == "scurve":
        power = F.lit(2 * 4.0**bend)
        rising, falling = F.pow(progress, power), F.pow(1 - progress, power)
        inside = rising / (rising + falling)
    else:
        inside = progress if bend == 0 else F.pow(progress, F.lit(10.0**bend))
        if shape == "equal":
            inside = F.sin(inside * (math.pi / 2))
    return F.when(progress >= 1, 1.0).when(progress > 0, inside).otherwise(0.0)


def bisect(goal: Column, steps: int = 40) -> Column:
    """The tension at which a power fade has the wanted gain half-way, by halving an interval a fixed number of times."""
    half = F.struct(F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = F.pow(F.lit(0.5), F.pow(F.lit(10.0), mid)) > goal  # more tension, less gain
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), half, step, lambda s: (s["lo"] + s["hi"]) / 2)


#: Fixed values of keys: the version of the arithmetic, and of each lane the number it begins with and its multiplier.
DSP_VERSION = 1
LANES = ((0x811C9DC5, 0x01000193), (0x01000193 ^ 0x5BD1E995, 0x01000197))
#: Parameters of an edit in the order of its signature; shapes are texts, the last one is a yes or no.
PARAMETERS = ("duration", "crop_start", "crop_end", "fade_in_end", "fade_out_start", "fade_in_shape", "fade_in_tension", "fade_out_shape", "fade_out_tension", "gain_db", "semitones", "reverse")


def shown_number(x: Column) -> Column:
    """A number to six places, halves up, as JSON writes it: no point without decimals, no zeros at the end, no minus zero."""
    fixed = (F.floor(x * 1e6 + 0.5) / 1e6).cast("decimal(30,6)").cast("string")
    plain = F.regexp_replace(fixed, r"\.?0+$", "")
    return F.when(plain == "-0", "0").otherwise(plain)


def signature(edit: dict[str, Column]) -> Column:
    """The rounded parameters of an edit as a JSON list, the same whatever noise its numbers carry."""
    parts = [F.lit(str(DSP_VERSION))]
    for name in PARAMETERS:
        if name == "reverse":
            parts.append(F.when(edit[name], "1").otherwise("0"))
        elif name.endswith("shape"):
            parts.append(F.concat(F.lit('"'), edit[name], F.lit('"')))
        else:
            parts.append(shown_number(edit[name]))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def hash_key(text: Column) -> Column:
    """A key of a plain text: two 32-bit lanes of the FNV-1a hash, as sixteen hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    low = F.lit(0xFFFFFFFF).cast("long")

    def lane(start: int, prime: int) -> Column:
        # A lane of 32 bits times the multiplier fits in 64.
        end = F.aggregate(codes, F.lit(start).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(prime).cast("long")).bitwiseAND(low))
        return F.lower(F.lpad(F.hex(end), 8, "0"))

    return F.concat(*(lane(*x) for x in LANES))


#: Dimensions of a fingerprint that belong to an axis, and what the second differences count of it.
CEPSTRAL, SECOND = 13, 0.7


def axis_weights(timbre: Column, brightness: Column, texture: Column, energy: Column, transient: Column) -> Column:
    """44 weights from five axes: 13 cepstral values, their differences and second differences, then centroid, flatness,
    bandwidth, loudness and zero crossings. The first of each cepstral block is loudness itself."""
    some = lambda first, rest: [first, *[rest] * (CEPSTRAL - 1)]
    blocks = some(energy, timbre) + some(energy, transient) + some(energy * SECOND, transient * SECOND)
    return F.array(*blocks, brightness, texture, brightness, energy, transient)


# colours


def hsl(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue in degrees, saturation and lightness in 0..1 of components in 0..1; a grey has hue and saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = top - low, (top + low) / 2
    hue = F.when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    return [F.when(span > 0, hue).otherwise(0.0), F.when(span > 0, span / (1 - F.abs(2 * light - 1))).otherwise(0.0), light]


def linear(c: Column) -> Column:
    """A component without the gamma of sRGB."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


#: Fixed values of the OKLab space: cone responses from linear components, and coordinates from their cube roots.
CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
COORDINATES = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """Lightness and two opponent coordinates of components in 0..1."""
    row = lambda ws, xs: sum((w * x for w, x in zip(ws, xs, strict=True)), F.lit(0.0))
    cones = [F.cbrt(row(ws, [linear(c) for c in (r, g, b)])) for ws in CONES]
    return [row(ws, cones) for ws in COORDINATES]


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(one: Column, other: Column) -> Column:
    """The contrast of two luminances, 1 to 21."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)
