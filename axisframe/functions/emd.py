"""Empirical mode decomposition of one series."""

from __future__ import annotations

import numpy as np

from .filters import analytic


def maxima(x: np.ndarray) -> np.ndarray:
    """Positions of local maxima; the ends count, a flat top counts once, in its middle (the lower one of two)."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    stops = np.concatenate([starts[1:], [len(x)]]) - 1
    v = x[starts]
    up = np.concatenate([[True], v[1:] > v[:-1]])
    down = np.concatenate([v[:-1] > v[1:], [True]])
    top = up & down
    return (starts[top] + stops[top]) // 2


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating cubic spline without a knot at the second and the last but one point, at rising places; fewer points give lower orders."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, slope = np.diff(x).astype(float), np.diff(y) / np.diff(x)
    # second derivatives m: tridiagonal inside; third derivative continuous at the two knots left out
    lower, diag, upper = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6 * np.diff(slope)
    diag[0] += h[0] * (1 + h[0] / h[1])
    upper[0] -= h[0] ** 2 / h[1]
    diag[-1] += h[-1] * (1 + h[-1] / h[-2])
    lower[-1] -= h[-1] ** 2 / h[-2]
    m = np.zeros(n)
    m[1:-1] = tridiagonal(lower, diag, upper, rhs)
    m[0] = m[1] - h[0] / h[1] * (m[2] - m[1])
    m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    j = np.clip(np.cumsum(np.bincount(np.searchsorted(at, x), minlength=len(at) + 1))[: len(at)] - 1, 0, n - 2)
    c1, c3 = slope - h * (2 * m[:-1] + m[1:]) / 6, np.diff(m) / (6 * h)
    b = at - x[j]
    return y[j] + b * (c1[j] + b * (m[j] / 2 + b * c3[j]))


def tridiagonal(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The solution of a diagonally dominant system by cyclic reduction: every second unknown is taken out at once."""
    n = len(diag)
    if n == 1:
        return rhs / diag
    a, b, c, d = (np.append(v, w) for v, w in ((lower, 0.0), (diag, 1.0), (upper, 0.0), (rhs, 0.0)))  # one more row, x = 0
    a[0] = c[n - 1] = 0.0
    odd = n // 2
    before, here, after = slice(0, 2 * odd, 2), slice(1, 2 * odd, 2), slice(2, 2 * odd + 1, 2)
    f, g = a[here] / b[before], c[here] / b[after]
    x = np.zeros(n + 2)  # x[i + 1] is unknown i
    x[2 : 2 * odd + 1 : 2] = tridiagonal(-f * a[before], b[here] - f * c[before] - g * a[after], -g * c[after], d[here] - f * d[before] - g * d[after])
    even = np.arange(0, n, 2)
    x[even + 1] = (d[even] - a[even] * x[even] - c[even] * x[even + 2]) / b[even]
    return x[1:-1]


def envelope(x: np.ndarray) -> np.ndarray:
    """Spline through the maxima, two of them mirrored beyond either end (one where the end itself is a maximum)."""
    n, at = len(x), maxima(x)
    if len(at) == 1:
        return np.full(n, x[at[0]])
    left = at[1:2] if at[0] == 0 else at[:2]
    right = at[-2:-1] if at[-1] == n - 1 else at[-2:]
    before, after = (1 - left)[::-1], (2 * n - right)[::-1]
    # the mirrors stand at 1-based distances from the ends
    after = after - 1 if at[-1] == n - 1 else after
    knots, values = np.concatenate([before, at, after]), np.concatenate([x[left][::-1], x[at], x[right][::-1]])
    keep = np.concatenate([[True], np.diff(knots) > 0])
    return cubic_spline(knots[keep], values[keep], np.arange(n))


def sift_once(x: np.ndarray) -> np.ndarray:
    return x - (envelope(x) - envelope(-x)) / 2


def _counts(x: np.ndarray) -> tuple[int, int]:
    return len(maxima(x)) + len(maxima(-x)), int((np.diff(np.sign(x)) != 0).sum())


def sift(x: np.ndarray, stable: int = 5, most: int = 1000) -> np.ndarray:
    """A mode: sift until extrema and zero crossings differ by one at most, then until both have stayed for ``stable`` sifts."""
    for _ in range(most):
        x = sift_once(x)
        last = _counts(x)
        if abs(last[0] - last[1]) <= 1:
            break
    same = 0
    for _ in range(most):
        if same >= stable:
            break
        x = sift_once(x)
        now = _counts(x)
        same, last = (same + 1 if now == last else 0), now
    return x


def emd(x: np.ndarray, max_modes: int = 10) -> np.ndarray:
    """Modes and, last, the residue; they add up to ``x``."""
    rest, modes = np.asarray(x, float), []
    while sum((len(maxima(rest)), len(maxima(-rest)))) > 2 and len(modes) < max_modes:
        modes.append(sift(rest))
        rest = rest - modes[-1]
    return np.stack([*modes, rest])


def eemd_member(x: np.ndarray, noise_std: float, num_sifts: int, seed: int) -> np.ndarray:
    """One member of the ensemble: the noisy input, int(log2 n) - 1 modes of ``num_sifts`` sifts each, the residue."""
    scale = x.std()
    rest = x / scale + np.random.default_rng(seed).normal(size=len(x)) * noise_std
    out = [rest]
    for _ in range(int(np.log2(len(x))) - 1):
        mode = rest
        for _ in range(num_sifts):
            mode = sift_once(mode)
        out.append(mode)
        rest = rest - mode
    return np.stack([*out, rest]) * scale


def instantaneous(modes: np.ndarray, samplerate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, amplitude, phase) of each mode; the frequency of the first and last sample is NaN."""
    h = analytic(modes)
    turn = np.angle(-h[..., 2:] * np.conj(h[..., :-2])) + np.pi
    freq = np.full(modes.shape, np.nan)
    freq[..., 1:-1] = 0.5 * turn / (2 * np.pi) * samplerate
    return freq, np.abs(h), np.angle(h)
