"""Filtering and resampling kernels; time is the last axis and all series of a batch go together."""

from __future__ import annotations

import numpy as np

from .design import butter, cheby1, hamming_lowpass


def lfilter(b, a, x: np.ndarray, zi: np.ndarray | None = None) -> np.ndarray:
    """Rational filter along the last axis, transposed direct form II; all other axes at once, and a series much longer than the filter rings by FFT."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    x = np.asarray(x, float)
    flat = x.reshape(-1, x.shape[-1])
    if not a[1:].any() and zi is None:  # FIR
        out = np.apply_along_axis(lambda r: np.convolve(r, b)[: len(r)], 1, flat) if flat.size else flat
        return out.reshape(x.shape)
    state = np.zeros((n - 1, len(flat))) if zi is None else np.broadcast_to(np.asarray(zi, float).reshape(n - 1, -1), (n - 1, len(flat)))
    size = flat.shape[1]
    # the filter's memory: until its response to an impulse is below the last digit of its start
    ring = int(np.ceil(np.log(1e-18) / np.log(min(max(np.abs(np.roots(a)).max(initial=0.0), 0.1), 1 - 1e-9)))) + n
    if size < max(256, 2 * ring):
        return _steps(b, a, flat, state)[0].reshape(x.shape)
    # the recursion gives the response to an impulse and the fading of the first state; long series are sums of these
    impulse = np.zeros((1, ring))
    impulse[0, 0] = 1
    h = _steps(b, a, impulse, np.zeros((n - 1, 1)))[0][0]
    wide = 1 << (size + ring - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(flat, wide, axis=-1) * np.fft.rfft(h, wide), wide, axis=-1)[:, :size]
    if zi is not None:
        out[:, :ring] += _steps(b, a, np.zeros((len(flat), ring)), state)[0]
    return out.reshape(x.shape)


def _steps(b: np.ndarray, a: np.ndarray, rows: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recursion step by step, all rows at once: (filtered rows, states at the end)."""
    n = len(b)
    held = np.zeros((n, len(rows)))
    held[:-1] = state
    out, columns = np.empty((rows.shape[1], len(rows))), np.ascontiguousarray(rows.T)
    for t, v in enumerate(columns):
        y = b[0] * v + held[0]
        held[:-1] = held[1:] + np.outer(b[1:], v) - np.outer(a[1:], y)
        out[t] = y
    return out.T, held[:-1]


def lfilter_zi(b, a) -> np.ndarray:
    """State in which a constant input of 1 gives the filter's steady output from the start."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    shift = np.eye(n - 1, k=1)
    shift[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n - 1) - shift, b[1:] - a[1:] * b[0])


def extend(x: np.ndarray, n: int, kind: str = "odd") -> np.ndarray:
    """``n`` samples more at both ends: mirrored through the end point (odd), mirrored (even) or held (constant).

    ``older`` is an odd one that leaves the second sample out at the front and takes the last one twice at the end.
    """
    if kind == "constant":
        return np.concatenate([np.repeat(x[..., :1], n, -1), x, np.repeat(x[..., -1:], n, -1)], -1)
    if n + (kind == "older") >= x.shape[-1]:
        raise ValueError(f"a series of {x.shape[-1]} samples is too short for {n} more at its ends")
    left, right = x[..., n:0:-1], x[..., -2 : -n - 2 : -1]
    if kind == "older":
        left, right = 2 * x[..., :1] - x[..., n + 1 : 1 : -1], 2 * x[..., -1:] - x[..., -1 : -n - 1 : -1]
    elif kind == "odd":
        left, right = 2 * x[..., :1] - left, 2 * x[..., -1:] - right
    elif kind != "even":
        raise ValueError(f"no extension {kind!r}")
    return np.concatenate([left, x, right], -1)


def filtfilt(b, a, x: np.ndarray, kind: str | None = "odd", padlen: int | None = None) -> np.ndarray:
    """Zero-phase filtering: forwards and backwards from steady states over extended ends (three filter lengths; ``older``: one sample less)."""
    taps = max(np.size(a), np.size(b))
    edge = 0 if kind is None else 3 * taps - (kind == "older") if padlen is None else padlen
    if x.shape[-1] <= edge:
        raise ValueError(f"a series must be longer than {edge} samples")
    padded = extend(x, edge, kind) if edge else x
    zi = lfilter_zi(b, a)
    flat = padded.reshape(-1, padded.shape[-1])
    y = lfilter(b, a, flat, zi[:, None] * flat[:, 0])
    y = lfilter(b, a, y[:, ::-1], zi[:, None] * y[:, -1])[:, ::-1].reshape(padded.shape)
    return y[..., edge : y.shape[-1] - edge] if edge else y


def buttfilt(x: np.ndarray, band, samplerate: float, kind: str = "stop", order: int = 4) -> np.ndarray:
    b, a = butter(order, np.asarray(band, float) / (samplerate / 2), kind)
    return filtfilt(b, a, x)


def smooth(x: np.ndarray, q: int, order: int | None = None, kind: str = "iir") -> np.ndarray:
    """What comes before every q-th sample is taken: a zero-phase Chebyshev filter (order 8, 0.05 dB, at 0.8/q) or a Hamming FIR (30 taps, at 1/q)."""
    if kind == "fir":
        return lfilter(hamming_lowpass((30 if order is None else order) + 1, 1 / q), [1.0], x)
    return filtfilt(*cheby1(8 if order is None else order, 0.05, 0.8 / q), x, "older")


def decimate(x: np.ndarray, q: int, order: int | None = None, kind: str = "iir") -> np.ndarray:
    """Every q-th sample of the smoothed series."""
    if not isinstance(q, int | np.integer):
        raise TypeError("q must be a whole number")
    if kind not in ("iir", "fir"):
        raise ValueError(f"no kind of decimation {kind!r}")
    return smooth(x, q, order, kind)[..., ::q]


def resample(x: np.ndarray, n: int, window: np.ndarray | None = None) -> np.ndarray:
    """Fourier resampling to ``n`` samples. The bin at half the lower rate is doubled going down, halved going up."""
    old = x.shape[-1]
    spec = np.fft.rfft(x, axis=-1)
    if window is not None:
        spec = spec * window[: spec.shape[-1]]
    least = min(n, old)
    out = np.zeros((*x.shape[:-1], n // 2 + 1), complex)
    keep = least // 2 + 1
    out[..., :keep] = spec[..., :keep]
    if least % 2 == 0 and n != old:
        out[..., least // 2] *= 2 if n < old else 0.5
    return np.fft.irfft(out, n, axis=-1) * (n / old)


def pad_to_pow2(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    more = (1 << max(0, n - 1).bit_length()) - n
    return np.concatenate([x, np.zeros((*x.shape[:-1], more))], -1)


def resampled(x: np.ndarray, samplerate: float, rate: float, pad: bool = False) -> np.ndarray:
    n = int(np.rint(x.shape[-1] * rate / samplerate))
    if not pad:
        return resample(x, n)
    wide = pad_to_pow2(x)
    return resample(wide, int(np.rint(wide.shape[-1] * rate / samplerate)))[..., :n]


def centered(x: np.ndarray, n: int) -> np.ndarray:
    """The middle ``n`` samples."""
    start = (x.shape[-1] - n) // 2
    return x[..., start : start + n]


def analytic(x: np.ndarray, pad: bool = False) -> np.ndarray:
    """The analytic signal: negative frequencies off, positive ones doubled."""
    n = x.shape[-1]
    wide = pad_to_pow2(x) if pad else x
    m = wide.shape[-1]
    gain = np.zeros(m)
    gain[0] = 1
    gain[1 : (m + 1) // 2] = 2
    if m % 2 == 0:
        gain[m // 2] = 1
    return np.fft.ifft(np.fft.fft(wide, axis=-1) * gain, axis=-1)[..., :n]


# Frequency bands of the human EEG in Hz.
BANDS = {"delta": (2, 4), "theta": (4, 8), "alpha": (9, 14), "beta": (16, 26), "gamma_1": (28, 42), "gamma_2": (44, 100)}


def hilbert_amplitude(x: np.ndarray, samplerate: float, bands: dict[str, tuple[float, float]] | None = None, pad: bool = False) -> dict[str, np.ndarray]:
    """Amplitude of the analytic signal in each band."""
    return {k: np.abs(analytic(buttfilt(x, b, samplerate, "pass"), pad)) for k, b in (bands or BANDS).items()}
