"""Matrix work on matrices of the size of the channel count: principal components and blind source separation."""

from __future__ import annotations

import numpy as np


def whitening(cov: np.ndarray, ncomps: int | None = None, eigratio: float = 1e6) -> np.ndarray:
    """Rows that map channels to components of variance 1, largest first; components whose eigenvalue is more than ``eigratio`` times smaller than the largest are left out."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: ncomps or len(values)]
    values, vectors = values[order], vectors[:, order]
    keep = values > values[0] / eigratio
    return (vectors[:, keep] / np.sqrt(values[keep])).T


def diagonalise(covs: np.ndarray, weights: np.ndarray | None = None, start: np.ndarray | None = None, steps: int = 100, tol: float = 1e-9) -> np.ndarray:
    """W that makes all W C_k W' nearly diagonal (weighted exhaustive off-diagonal minimisation).

    ``covs``: (lags, d, d), lag 0 first. ``weights``: (d, d, lags, lags) for each pair, identity without. Each
    step solves, for every pair i != j, the 2 x 2 problem for the mixing that is left, and takes it out.
    """
    lags, d, _ = covs.shape
    sym = (covs + covs.transpose(0, 2, 1)) / 2
    if start is None:
        start = whitening(sym[0] + 1e-12 * np.trace(sym[0]) / d * np.eye(d), eigratio=np.inf)
    w = start
    for _ in range(steps):
        m = np.einsum("ia,kab,jb->kij", w, sym, w)
        scale = 1 / np.sqrt(np.maximum(np.abs(np.diagonal(m[0])), 1e-300))
        w, m = scale[:, None] * w, m * scale[:, None] * scale
        diag = np.diagonal(m, axis1=1, axis2=2)  # (lags, d)
        if weights is None:
            pi = np.einsum("ki,kj->ij", diag, diag)
            bii = np.broadcast_to(np.diagonal(pi)[:, None], (d, d))
            bjj, bij = bii.T, pi
            ci, cj = np.einsum("kij,kj->ij", m, diag), np.einsum("kij,ki->ij", m, diag)
        else:
            bii = np.einsum("ki,ijkl,li->ij", diag, weights, diag)
            bjj = np.einsum("kj,ijkl,lj->ij", diag, weights, diag)
            bij = np.einsum("ki,ijkl,lj->ij", diag, weights, diag)
            ci, cj = np.einsum("kij,ijkl,lj->ij", m, weights, diag), np.einsum("kij,ijkl,li->ij", m, weights, diag)
        # m_ij(k) ~ a_ij m_jj(k) + a_ji m_ii(k)
        det = bii * bjj - bij**2
        np.fill_diagonal(det, 1)
        a = (bii * ci - bij * cj) / np.where(np.abs(det) < 1e-12, np.inf, det)
        np.fill_diagonal(a, 0)
        biggest = np.abs(a).max(initial=0)
        w = np.linalg.solve(np.eye(d) + a * min(1, 0.5 / max(biggest, 1e-300)) if biggest > 0.5 else np.eye(d) + a, w)
        if biggest < tol:
            break
    m0 = np.einsum("ia,ab,ib->i", w, sym[0], w)
    return w / np.sqrt(np.abs(m0))[:, None]


def autoregression(acov: np.ndarray, rmax: float = 0.99) -> tuple[np.ndarray, float]:
    """(polynomial, innovation variance) by Yule-Walker; roots beyond ``rmax`` are drawn back to it."""
    p = len(acov) - 1
    r = acov[np.abs(np.arange(p)[:, None] - np.arange(p))]
    r = r + 1e-10 * acov[0] * np.eye(p)
    poly = np.concatenate([[1.0], -np.linalg.solve(r, acov[1:])])
    roots = np.roots(poly)
    size = np.abs(roots)
    roots = np.where(size > rmax, roots / np.maximum(size, 1e-300) * rmax, roots)
    poly = np.poly(roots).real
    return poly, float(max(acov @ np.pad(poly, (0, p + 1 - len(poly))), 1e-12 * abs(acov[0]) + 1e-300))


def ar_covariance(poly: np.ndarray, variance: float, lags: int) -> np.ndarray:
    """Autocovariances 0..lags-1 of an autoregressive process, from its spectrum."""
    n = 4096
    spec = variance / np.maximum(np.abs(np.fft.fft(poly, n)) ** 2, 1e-12)
    return np.fft.ifft(spec).real[:lags]


def pair_weights(polys, variances, lags: int, eps: float = 5e-7) -> np.ndarray:
    """(d, d, lags, lags): inverse covariance of a pair's sample lagged cross-covariances, if the sources are these processes."""
    d = len(polys)
    i, j = np.arange(lags)[:, None], np.arange(lags)
    out = np.zeros((d, d, lags, lags))
    for a in range(d):
        for b in range(a, d):
            phi = ar_covariance(np.convolve(polys[a], polys[b]), variances[a] * variances[b], 2 * lags)
            c = phi[np.abs(i - j)] + phi[i + j]
            out[a, b] = out[b, a] = np.linalg.inv(c + eps * np.trace(c) / lags * np.eye(lags))
    return out


def wasobi(covs: np.ndarray, rmax: float = 0.99, eps: float = 5e-7, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(W, first W) for sources with different spectra: joint diagonalisation of the lagged covariances, first
    unweighted, then with the weights that are best for the autoregressive spectra of the sources found so far."""
    first = w = diagonalise(covs)
    sym = (covs + covs.transpose(0, 2, 1)) / 2
    for _ in range(rounds):
        acov = np.einsum("ia,kab,ib->ik", w, sym, w)
        models = [autoregression(r, rmax) for r in acov]
        w = diagonalise(covs, pair_weights([p for p, _ in models], [v for _, v in models], len(covs), eps), w)
    return w, first


def crlb_isr(polys, variances) -> np.ndarray:
    """Lower bound of the interference-to-signal ratio between sources, times the number of samples: from how much two spectra differ."""
    n, d = 4096, len(polys)
    spec = np.stack([v / np.maximum(np.abs(np.fft.fft(p, n)) ** 2, 1e-12) for p, v in zip(polys, variances, strict=True)])
    spec /= spec.mean(axis=1, keepdims=True)
    out = np.zeros((d, d))
    for a in range(d):
        for b in range(d):
            if a != b:
                fab, fba = (spec[a] / spec[b]).mean(), (spec[b] / spec[a]).mean()
                out[a, b] = fba / (fab * fba - 1) if fab * fba > 1 + 1e-12 else np.inf
    return out


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The orthogonal matrix r with the least ||a r - b||."""
    return procrustes_of(a.T @ b)


def procrustes_of(products: np.ndarray) -> np.ndarray:
    """The same from the sums of products aᵀ b, which can be aggregated over any number of rows."""
    u, _, vt = np.linalg.svd(products)
    return u @ vt


def running_averages(x: np.ndarray, fast: float = 0.5, slow: float = 0.975) -> np.ndarray:
    """Fast average of what a slow average leaves, over time."""
    from .filters import lfilter

    x, start = np.asarray(x, float), float(np.mean(x[:10]))
    level = lfilter([1 - slow], [1, -slow], x[None], np.array([[slow * start]]))[0]
    before = np.concatenate([[start], level[:-1]])
    return lfilter([1 - fast], [1, -fast], (x - before)[None])[0]


def find_blinks(x: np.ndarray, radius: int, fast: float = 0.5, slow: float = 0.975, threshold: float | None = None) -> np.ndarray:
    """Mask of samples from ``radius`` before to ``radius`` - 1 after a large product of the forward and backward averages.

    ``threshold``: one standard deviation of its size, if not given. Unlike older implementations sample 0 is only
    marked when it is in reach of a blink.
    """
    both = np.abs(running_averages(x, fast, slow) * running_averages(x[::-1], fast, slow) / 2)
    hits = np.flatnonzero(both > (both.std() if threshold is None else threshold))
    near = np.zeros(len(x) + 1, int)
    np.add.at(near, np.maximum(hits - radius, 0), 1)
    np.add.at(near, np.minimum(hits + radius, len(x)), -1)
    return np.cumsum(near)[:-1] > 0


def _clean_power_of_two(x: np.ndarray, ratio: float, radius: int, threshold: float | None) -> tuple[np.ndarray, float]:
    from .wavelets import iswt, swt

    level = int(np.log2(len(x)))
    coefs = swt(x, level)

    def removed(t: float) -> np.ndarray:
        return iswt([(a, np.where(np.abs(d) > t, d, 0)) for a, d in coefs])

    if threshold is not None:
        return x - removed(threshold), threshold
    bad = find_blinks(x, radius)
    if not bad.any():
        return x, 0.0
    t, corr = 1.1, lambda a, b: max(np.corrcoef(a, b)[0, 1], 1e-6) if a.std() and b.std() else 1e-6
    while True:
        t += 0.5
        gone = removed(t)
        good = corr(x[~bad], (x - gone)[~bad]) if (~bad).sum() > 1 else 1.0
        if corr(x[bad], gone[bad]) / good <= ratio or t > np.abs(x).max() * 2 ** (level / 2) + 2:
            return x - gone, t


def clean_component(x: np.ndarray, ratio: float = 2.5, radius: int = 10, threshold: float | None = None) -> tuple[np.ndarray, float]:
    """A component without its strong transients: wavelet details above a threshold are its artifacts and are taken off.

    The threshold rises from 1.6 by 0.5 until artifacts resemble the input in marked samples at most ``ratio`` times as
    much as what is left does elsewhere. The first 2**k samples are cleaned, then the last 2**k with the same threshold.
    """
    n = 1 << (len(x).bit_length() - 1)
    out = np.array(x, float)
    out[:n], t = _clean_power_of_two(out[:n], ratio, radius, threshold)
    if t and n < len(x):
        out[-n:], _ = _clean_power_of_two(out[-n:], ratio, radius, t)
    return out, t
