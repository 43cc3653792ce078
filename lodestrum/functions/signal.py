"""Numpy kernels for signals: frame features, resampling, 16-bit floats and colour clusters."""

from __future__ import annotations

import numpy as np

#: Analysis rate, window, hop, mel bands and cepstral coefficients of a fingerprint frame.
RATE, SIZE, HOP, MELS, CEPSTRA = 48_000, 2048, 1200, 40, 13
F16_MAX = 65504.0


def mel(hz: np.ndarray | float) -> np.ndarray | float:
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def mel_bank(rate: int = RATE, size: int = SIZE, bands: int = MELS) -> np.ndarray:
    """Triangles equally spaced in mel, one row for each band."""
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(size, 1 / rate)[None, :]
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)))


def slaney(hz: np.ndarray | float) -> np.ndarray:
    """The mel scale that is linear up to 1,000 Hz and logarithmic beyond."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def slaney_hz(mels: np.ndarray) -> np.ndarray:
    return np.where(mels < 15, mels * 200 / 3, 1000 * np.exp((mels - 15) * np.log(6.4) / 27))


def log_mel(x: np.ndarray, rate: int = RATE, size: int = 1024, hop: int = 480, bands: int = 64, low: float = 50.0, high: float = 14_000.0) -> np.ndarray:
    """Log power in mel bands, (frames, bands) in decibels: ends reflected, bands of equal area on the Slaney scale, a floor of
    1e-10."""
    half = (size - 1) // 2 + 1
    x = np.asarray(x, float)
    padded = np.pad(x, half, mode="reflect") if len(x) > 1 else np.pad(x, half)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    edges = slaney_hz(np.linspace(slaney(low), slaney(high), bands + 2))
    hz = np.fft.rfftfreq(size, 1 / rate)[None, :]
    below, middle, above = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((hz - below) / (middle - below), (above - hz) / (above - middle))) * 2 / (above - below)
    return 10 * np.log10(np.maximum(power @ bank.T, 1e-10))


def polyphase(x: np.ndarray, rate: int, wanted: int, zeros: int = 12, beta: float = 8.0, roll_off: float = 0.9) -> np.ndarray:
    """A signal at another rate, by a Kaiser-windowed sinc with one set of weights for each phase that occurs."""
    x = np.asarray(x, float)
    common = int(np.gcd(rate, wanted))
    up, down = wanted // common, rate // common
    scale = min(1.0, wanted / rate) * roll_off
    reach = int(np.ceil(zeros / scale))
    taps = np.arange(-reach, reach + 1)
    phase = np.arange(up) / up  # where between two samples an output can lie
    at = taps[None, :] - phase[:, None]
    inside = np.clip(1 - (at * scale / zeros) ** 2, 0, None)
    weights = np.sinc(at * scale) * np.i0(beta * np.sqrt(inside)) / np.i0(beta) * (np.abs(at * scale) <= zeros)
    weights /= weights.sum(1, keepdims=True)
    n = int(np.ceil(len(x) * up / down))
    base, own = np.divmod(np.arange(n) * down, up)
    padded = np.pad(x, reach + 1)
    return (padded[base[:, None] + taps[None, :] + reach + 1] * weights[own]).sum(1)


def dct(n_in: int, n_out: int) -> np.ndarray:
    k, m = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    return np.cos(np.pi * k * (m + 0.5) / n_in) * np.sqrt(2 / n_in)


def framed(x: np.ndarray, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """Windows of a signal, one at least; the last ones are padded with zeros."""
    n = max(1, -(-max(len(x) - size, 0) // hop) + 1)
    padded = np.zeros((n - 1) * hop + size)
    padded[: len(x)] = x[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:n]


def slopes(m: np.ndarray) -> np.ndarray:
    """Regression over two frames on either side, the ends repeated."""
    p = np.pad(m, ((2, 2), (0, 0)), mode="edge")
    return ((p[3:-1] - p[1:-3]) + 2 * (p[4:] - p[:-4])) / 10


def frame_features(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """44 numbers for each frame: cepstra with first and second slopes, then centroid, flatness, bandwidth, log RMS, zero crossings."""
    w = framed(np.asarray(x, float))
    magnitude = np.abs(np.fft.rfft(w * np.hanning(SIZE), axis=1))
    hz = np.fft.rfftfreq(SIZE, 1 / rate)
    total = magnitude.sum(1) + 1e-12
    centroid = (magnitude * hz).sum(1) / total
    bandwidth = np.sqrt((magnitude * (hz[None, :] - centroid[:, None]) ** 2).sum(1) / total)
    power = magnitude**2 + 1e-12
    flatness = np.exp(np.log(power).mean(1)) / power.mean(1)
    rms = np.log(np.sqrt((w**2).mean(1)) + 1e-9)
    crossings = (np.diff(np.signbit(w), axis=1)).mean(1)
    cepstra = np.log(power @ mel_bank(rate).T + 1e-10) @ dct(MELS, CEPSTRA).T
    first = slopes(cepstra)
    stats = np.stack([centroid / (rate / 2), flatness, bandwidth / (rate / 2), rms, crossings], 1)
    return np.hstack([cepstra, first, slopes(first), stats])


def half_encode(x: np.ndarray) -> bytes:
    """16-bit floats, clamped to the largest finite one; ties round to even."""
    return np.clip(np.asarray(x, np.float64), -F16_MAX, F16_MAX).astype("<f2").tobytes()


def half_decode(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").astype(np.float32)


def resample(x: np.ndarray, ratio: float, zeros: int = 24, beta: float = 9.0, cutoff: float = 0.91) -> np.ndarray:
    """x at positions m * ratio, by a Kaiser-windowed sinc that also limits the band when ratio is over 1."""
    n = int(np.floor((len(x) - 1) / ratio)) + 1 if len(x) else 0
    band = cutoff * min(1.0, 1 / ratio)
    reach = int(np.ceil(zeros / band))
    p = np.arange(n) * ratio
    base = np.floor(p).astype(int)
    taps = np.arange(-reach, reach + 1)
    at = base[:, None] + taps[None, :]
    d = p[:, None] - at
    window = np.i0(beta * np.sqrt(np.clip(1 - (d / (reach + 1)) ** 2, 0, 1))) / np.i0(beta)
    h = band * np.sinc(band * d) * window
    padded = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, max(0, len(x) - 1))], 0.0) if n else np.zeros((0, 1))
    return (padded * h).sum(1) / np.where(np.abs(h.sum(1)) > 1e-12, h.sum(1), 1)


def palette(pixels: np.ndarray, k: int, steps: int = 12) -> list[tuple[np.ndarray, int]]:
    """Deterministic colour clusters: the first centre is the pixel nearest the mean, each next one the pixel farthest from
    all centres; then a few Lloyd steps. Clusters of fewer than two pixels, or 0.8 % of them, are left out."""
    p = np.asarray(pixels, float)
    centres = [p[((p - p.mean(0)) ** 2).sum(1).argmin()]]
    while len(centres) < k:
        away = np.min([((p - c) ** 2).sum(1) for c in centres], axis=0)
        if away.max() <= 0:
            break
        centres.append(p[away.argmax()])
    c = np.array(centres)
    for _ in range(steps):
        own = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([p[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    own = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
    sizes = np.bincount(own, minlength=len(c))
    return sorted([(c[j], int(sizes[j])) for j in range(len(c)) if sizes[j] >= max(2, 0.008 * len(p))], key=lambda x: -x[1])
