"""Changes of power within a window, by quadratic inverse theory.

The squares of tapered transforms of a process whose power changes in time expand in the eigenvectors of the squared
kernel of the tapers' band. The index of a frequency is the weighted squared distance of the coefficients of the data from those of a
steady process.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from intervalia.operators.dsp import slepian


def band_kernel(n: int, bandwidth: float) -> np.ndarray:
    """sin(2 pi W d) / (pi d) of all pairs of places, W being the bandwidth over n."""
    d = np.subtract.outer(np.arange(n), np.arange(n)).astype(float)
    w = bandwidth / n
    return 2 * w * np.sinc(2 * w * d)


def basis(n: int, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """The leading 4 * bandwidth eigenvectors (columns, of mean square 1) and eigenvalues of the squared kernel."""
    values, vectors = np.linalg.eigh(n * band_kernel(n, bandwidth) ** 2)
    k = round(4 * bandwidth)
    v = np.sqrt(n) * vectors[:, ::-1][:, :k]
    turned = ((n - 1 - 2 * np.arange(n))[:, None] * v).sum(0) < 0
    v[:, turned] = v[::-1, turned]
    return v, values[::-1][:k]


@lru_cache(maxsize=8)
def coefficients(n: int, bandwidth: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tapers (2 * bandwidth of them), the matrices of the expansion (order, tapers, tapers) and the means of the eigenvectors."""
    k = 2 * bandwidth
    tapers = slepian(n, bandwidth, k)
    share = np.einsum("kn,nm,km->k", tapers, band_kernel(n, bandwidth), tapers)
    v = basis(n, bandwidth)[0][:, :order]
    root = np.sqrt(np.maximum(share, 0))
    return tapers, np.einsum("jn,kn,nl,j,k->ljk", tapers, tapers, v, root, root, optimize=True), v.mean(0)


def index(x: np.ndarray, bandwidth: int = 3, order: int = 6) -> np.ndarray:
    """The index of each frequency of rfft; order is 4 * bandwidth at most. Frequencies without power have 0."""
    tapers, a, mean = coefficients(len(x), bandwidth, order)
    j = np.fft.rfft(tapers * x, axis=1)
    weight = np.einsum("ljk,lkj->l", a, a)
    power = (np.abs(j) ** 2).mean(0)
    c = np.einsum("jf,ljk,kf->lf", j.conj(), a, j, optimize=True).real / weight[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (weight[:, None] * (c / power - mean[:, None]) ** 2).sum(0)
    return np.where(power > 0, out, 0.0)
