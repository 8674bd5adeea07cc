"""Digital filter design: analog prototypes as zeros, poles and gain, then the bilinear transform."""

from __future__ import annotations

import numpy as np

Zpk = tuple[np.ndarray, np.ndarray, float]


def butter_prototype(order: int) -> Zpk:
    m = np.arange(1 - order, order, 2)
    return np.zeros(0), -np.exp(1j * np.pi * m / (2 * order)), 1.0


def cheby1_prototype(order: int, ripple: float) -> Zpk:
    """Poles on an ellipse; ``ripple`` in dB below the peak."""
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    angle = np.pi * np.arange(1 - order, order, 2) / (2 * order)
    p = -np.sinh(mu + 1j * angle)
    k = float(np.prod(-p).real)
    return np.zeros(0), p, k / np.sqrt(1 + eps**2) if order % 2 == 0 else k


def to_band(proto: Zpk, kind: str, low: float, high: float | None) -> Zpk:
    """Low-pass prototype with cut-off 1 to the analog band (frequencies already warped)."""
    z, p, k = proto
    n = len(p) - len(z)
    if kind == "low":
        return z * low, p * low, k * low**n
    if kind == "high":
        gain = (np.prod(-z) / np.prod(-p)).real
        return np.append(low / z, np.zeros(n)), low / p, k * gain
    width, centre = high - low, np.sqrt(low * high)

    def both(q):
        root = np.sqrt(q.astype(complex) ** 2 - centre**2)
        return np.concatenate([q + root, q - root])

    if kind == "pass":
        return np.append(both(z * width / 2), np.zeros(n)), both(p * width / 2), k * width**n
    gain = (np.prod(-z) / np.prod(-p)).real
    return np.concatenate([both(width / 2 / z), np.full(n, 1j * centre), np.full(n, -1j * centre)]), both(width / 2 / p), k * gain


def bilinear(analog: Zpk, fs2: float = 4.0) -> Zpk:
    z, p, k = analog
    gain = (np.prod(fs2 - z) / np.prod(fs2 - p)).real
    return np.append((fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))), (fs2 + p) / (fs2 - p), k * gain


def iir(proto: Zpk, band: float | tuple[float, float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a filter whose band is given as a share of half the sample rate."""
    edges = np.atleast_1d(np.asarray(band, float))
    kind = {"lowpass": "low", "highpass": "high", "bandpass": "pass", "bandstop": "stop"}.get(kind, kind)
    if kind not in ("low", "high", "pass", "stop"):
        raise ValueError(f"no kind of filter {kind!r}")
    if len(edges) != (2 if kind in ("pass", "stop") else 1):
        raise ValueError(f"a {kind} filter needs {2 if kind in ('pass', 'stop') else 1} band edges")
    if (edges <= 0).any() or (edges >= 1).any() or (np.diff(edges) <= 0).any():
        raise ValueError("band edges must rise and lie between 0 and half the sample rate")
    warped = 4 * np.tan(np.pi * edges / 2)
    z, p, k = bilinear(to_band(proto, kind, warped[0], warped[1] if len(warped) > 1 else None))
    return np.atleast_1d(k * np.poly(z)).real, np.atleast_1d(np.poly(p)).real


def butter(order: int, band, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    return iir(butter_prototype(order), band, kind)


def cheby1(order: int, ripple: float, band, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    return iir(cheby1_prototype(order, ripple), band, kind)


def hamming_lowpass(taps: int, cutoff: float) -> np.ndarray:
    """Windowed-sinc low-pass with gain 1 at 0; ``cutoff`` as a share of half the sample rate."""
    m = np.arange(taps) - (taps - 1) / 2
    h = cutoff * np.sinc(cutoff * m) * np.hamming(taps)
    return h / h.sum()


def firls(taps: int, bands: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Least-squares linear-phase FIR of odd length: ``bands`` as rising pairs of shares of half the sample rate,
    ``gains`` at their ends, linear between."""
    bands, gains = np.asarray(bands, float).reshape(-1, 2), np.asarray(gains, float).reshape(-1, 2)
    half = taps // 2
    k = np.arange(half + 1)
    q, b = np.zeros((half + 1, half + 1)), np.zeros(half + 1)

    def cosines(n, f):  # integral of cos(pi n f) from 0 to f
        return f * np.sinc(n * f)

    for (lo, hi), (g0, g1) in zip(bands, gains, strict=True):
        for a, sign in ((hi, 1), (lo, -1)):
            q += sign * (cosines(k[:, None] - k, a) + cosines(k[:, None] + k, a)) / 2
        slope = (g1 - g0) / (hi - lo)
        for a, sign in ((hi, 1), (lo, -1)):
            base = g0 - slope * lo
            ramp = np.where(k == 0, a * a / 2, a * np.sin(np.pi * k * a) / np.where(k == 0, 1, np.pi * k) + (np.cos(np.pi * k * a) - 1) / np.where(k == 0, 1, np.pi * k) ** 2)
            b += sign * (base * cosines(k, a) + slope * ramp)
    h = np.linalg.solve(q, b)
    return np.concatenate([h[:0:-1] / 2, h[:1], h[1:] / 2])


def response(b: np.ndarray, a: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Complex gain at shares of half the sample rate."""
    z = np.exp(-1j * np.pi * np.asarray(freq))
    return np.polyval(b[::-1], z) / np.polyval(a[::-1], z)
