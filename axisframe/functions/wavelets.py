"""Wavelet kernels: complex Morlet wavelets and their convolution, and the stationary db3 transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .filters import centered


def morlet(n: int, w: float = 5.0, s: float = 1.0, complete: bool = True) -> np.ndarray:
    """Complex Morlet wavelet on ``n`` points from -2 pi s to 2 pi s; ``complete`` takes off its mean."""
    x = np.linspace(-2 * np.pi * s, 2 * np.pi * s, n)
    wave = np.exp(1j * w * x)
    if complete:
        wave -= np.exp(-0.5 * w**2)
    return wave * np.exp(-0.5 * x**2) * np.pi**-0.25


def morlet_at(freq: float, t: np.ndarray, width: float) -> np.ndarray:
    """Closed form at times ``t``, of energy 1 over continuous time."""
    st = width / (2 * np.pi * freq)
    return np.exp(-(t**2) / (2 * st**2)) * np.exp(2j * np.pi * freq * t) / np.sqrt(st * np.sqrt(np.pi))


def phase_power_closed(rows: np.ndarray, freqs, samplerate: float, width: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """(phase, power) by the closed form on 3.5 standard deviations to either side, direct convolution; the step is no part of the sum."""
    c = []
    for f in np.atleast_1d(freqs):
        reach = 3.5 * width / (2 * np.pi * f)
        kernel = morlet_at(f, np.arange(-reach, reach, 1 / samplerate), width)
        full = [np.convolve(r, kernel) for r in rows]
        start = int(np.ceil(len(kernel) / 2)) - 1
        c.append([x[start : start + rows.shape[-1]] for x in full])
    c = np.array(c)
    return np.where(c == 0, 0, np.angle(c)), np.abs(c) ** 2


def _spread(values, n: int, name: str) -> np.ndarray:
    v = np.atleast_1d(np.asarray(values, float))
    if not len(v) or n % len(v):
        raise ValueError(f"{n} frequencies can't be shared out over {len(v)} {name}")
    return np.repeat(v, n // len(v))


def morlet_kernels(freqs, widths=5.0, samplerates=1.0, windows=7.0, complete: bool = True) -> list[np.ndarray]:
    """One kernel for each frequency, of energy 1 over time in seconds. Shorter parameter lists are stretched: each entry serves its share of frequencies in order."""
    f = np.atleast_1d(np.asarray(freqs, float))
    if not len(f):
        raise ValueError("a frequency is needed")
    w, sr, win = (_spread(v, len(f), k) for v, k in ((widths, "widths"), (samplerates, "samplerates"), (windows, "windows")))
    st = w / (2 * np.pi * f)
    out = []
    for i in range(len(f)):
        n = int(np.ceil(st[i] * sr[i] * win[i]))
        k = morlet(n, w[i], f[i] * n / (2 * w[i] * sr[i]), complete)
        out.append(k / np.sqrt((np.abs(k) ** 2).sum() / sr[i]))
    return out


def fft_convolve(kernels: list[np.ndarray], rows: np.ndarray, mode: str = "same") -> list[np.ndarray]:
    """Every kernel with every row: one (rows, time) array for each kernel."""
    return list(_convolved(kernels, rows, mode))


def _convolved(kernels: list[np.ndarray], rows: np.ndarray, mode: str = "same") -> Iterator[np.ndarray]:
    n = rows.shape[-1]
    longest = max(len(k) for k in kernels)
    size = 1 << (n + longest - 2).bit_length()
    spec = np.fft.fft(rows, size, axis=-1)
    for k in kernels:
        full = np.fft.ifft(spec * np.fft.fft(k, size), axis=-1)[..., : n + len(k) - 1]
        if mode == "full":
            yield full
        elif mode == "same":
            yield centered(full, max(n, len(k)))
        elif mode == "valid":
            yield centered(full, abs(n - len(k)) + 1)
        else:
            raise ValueError(f"no mode {mode!r}")


def phase_power(rows: np.ndarray, freqs, samplerate: float, widths=5.0, windows=7.0, complete: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(phase, power), each (frequencies, rows, time)."""
    phase, power = zip(*phase_powers(rows, freqs, samplerate, widths, windows, complete), strict=True)
    return np.stack(phase), np.stack(power)


def phase_powers(rows: np.ndarray, freqs, samplerate: float, widths=5.0, windows=7.0, complete: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phase, power) of one frequency after the other, each (rows, time)."""
    kernels = morlet_kernels(freqs, widths, samplerate, windows, complete)
    if max(map(len, kernels)) > rows.shape[-1]:
        raise ValueError(f"the longest wavelet has {max(map(len, kernels))} samples, the data {rows.shape[-1]}")
    for c in _convolved(kernels, rows):
        yield np.where(c == 0, 0, np.angle(c)), np.abs(c) ** 2


# The Daubechies wavelet of three vanishing moments, low-pass.
DB3 = np.array([0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656])


def _filters(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    return low, high


def swt(x: np.ndarray, level: int, low: np.ndarray = DB3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stationary transform with periodic ends: (approximation, detail) of levels ``level``..1, each as long as x."""
    n = x.shape[-1]
    if n % (1 << level):
        raise ValueError(f"{n} samples are no multiple of {1 << level}")
    lo, hi = _filters(low)
    out, approx = [], x
    for j in range(level):
        a = d = 0
        for k in range(len(lo)):  # taps stand 2**j apart
            shifted = np.roll(approx, -k * (1 << j), axis=-1)
            a, d = a + lo[k] * shifted, d + hi[k] * shifted
        approx, detail = a, d
        out.append((approx, detail))
    return out[::-1]


def iswt(coefs: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray = DB3) -> np.ndarray:
    """Inverse: at each level the mean of what the even and the odd samples give back."""
    lo, hi = _filters(low)
    x = coefs[0][0]
    for i, (_, detail) in enumerate(coefs):
        step = 1 << (len(coefs) - 1 - i)
        x = sum(a * np.roll(x, k * step, axis=-1) + b * np.roll(detail, k * step, axis=-1) for k, (a, b) in enumerate(zip(lo, hi, strict=True))) / 2
    return x
