"""Tree noise for continual release, and the Zipf-Mandelbrot workload distribution."""

from __future__ import annotations

import hashlib
import math

import numpy as np


def leaves(steps: int) -> int:
    return 1 << math.ceil(math.log2(steps)) if steps > 1 else 1


def variances(steps: int, sigma: float) -> np.ndarray:
    """Variance of the noise in each prefix sum: half of sigma squared over 1 - 2^-levels, for every set bit."""
    out = np.zeros(steps)
    for i in range(steps):
        out[i] = sum(sigma**2 / (2 * (1 - 2.0 ** -(h + 1))) for h in range((i + 1).bit_length()) if (i + 1) >> h & 1)
    return out


def generator(secret: bytes, *name: object) -> np.random.Generator:
    """A stream of its own for each tree, expanded from the run's secret: a task that runs again draws the same noise."""
    key = hashlib.sha256(secret + repr(name).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(key[:16], "big")))


def noise_path(steps: int, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """Noise in the prefix sum at each step, of one tree."""
    return noise_paths(steps, sigma, [rng])[0]


def noise_paths(steps: int, sigma: float, rngs: list[np.random.Generator]) -> np.ndarray:
    """Noise in the prefix sum at each step, a row for each generator. Every node of a complete binary tree holds independent
    noise; a node's estimate joins its own with its children's, each weighted by inverse variance; a prefix is the sum of
    its canonical nodes."""
    if sigma == 0 or not rngs:
        return np.zeros((len(rngs), steps))
    n = leaves(steps)
    drawn = sigma * np.stack([rng.standard_normal(2 * n - 1) for rng in rngs])
    i = np.arange(1, steps + 1)
    out, below, at, h = np.zeros((len(rngs), steps)), drawn[:, :n], n, 0
    while True:
        bit = np.flatnonzero(i >> h & 1)
        out[:, bit] += below[:, (i[bit] >> h) - 1]
        size = below.shape[1] // 2
        if not size:
            return out
        h += 1
        share = 2.0**h / (2.0 ** (h + 1) - 1)
        below = share * drawn[:, at : at + size] + (1 - share) * (below[:, ::2] + below[:, 1::2])
        at += size


def zipf_mandelbrot_cdf(n: int, q: float, s: float) -> np.ndarray:
    p = (np.arange(1, n + 1) + q) ** -s
    c = np.cumsum(p)
    return c / c[-1]


def zipf_mandelbrot_mean(n: int, q: float, s: float) -> float:
    """Expected rank: H(s - 1) / H(s) - q, over the generalised harmonic numbers of ranks 1 + q to n + q."""
    k = np.arange(1, n + 1) + q
    return float((k ** (1 - s)).sum() / (k**-s).sum() - q)
