"""K-means for inverted lists: k-means++ seeds, Lloyd rounds by matrix products, on a bounded sample.

Spherical for inner product and cosine (centers have length 1), by majority of bits for bit vectors. An empty
cluster gets a random sample; without samples the centers are random. Everything is seeded.
"""

from __future__ import annotations

import numpy as np

from ..functions.kinds import VectorError

MAX_ROUNDS = 500
#: Most memory for the sample, the centers and their distances, in bytes.
MEMORY = 512 << 20


def sample_size(lists: int) -> int:
    return max(50 * lists, 10_000)


def check_memory(samples: int, lists: int, dim: int, limit: int = MEMORY) -> None:
    need = 4 * (samples * dim + lists * dim) + 8 * (samples + lists) + 8 * min(samples, 4096) * lists
    if need > limit:
        raise VectorError(f"memory required is {need / (1 << 20):.0f} MB, limit is {limit / (1 << 20):.0f} MB")


def _distances(x: np.ndarray, centers: np.ndarray, spherical: bool) -> np.ndarray:
    if spherical:
        return np.arccos(np.clip(x @ centers.T, -1, 1)) / np.pi
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * x @ centers.T))


def assign(x: np.ndarray, centers: np.ndarray, spherical: bool = False) -> np.ndarray:
    """The nearest center of each row; of equal ones the first."""
    if spherical:
        return np.concatenate([np.empty(0, np.int64), *((x[a : a + 4096] @ centers.T).argmax(1) for a in range(0, len(x), 4096))])
    return np.concatenate([np.empty(0, np.int64), *(_distances(x[a : a + 4096], centers, False).argmin(1) for a in range(0, len(x), 4096))])


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x**2).sum(1))
    return x / np.where(norms > 0, norms, 1)[:, None]


def kmeans(x: np.ndarray, lists: int, spherical: bool = False, bits: bool = False, seed: int = 0, rounds: int = MAX_ROUNDS) -> np.ndarray:
    """Centers of rows of doubles (bits: of zeros and ones, the centers too)."""
    r = np.random.default_rng(seed)
    dim = x.shape[1]
    check_memory(len(x), lists, dim)
    if not len(x):
        made = r.random((lists, dim))
        return (made > 0.5).astype(float) if bits else _unit(made) if spherical else made
    if spherical:
        x = _unit(x)
    centers = np.empty((lists, dim))
    centers[0] = x[r.integers(len(x))]
    weight = np.full(len(x), np.inf)
    for i in range(1, lists):
        weight = np.minimum(weight, _distances(x, centers[i - 1 : i], spherical)[:, 0] ** 2)
        total = weight.sum()
        centers[i] = x[r.choice(len(x), p=weight / total)] if total > 0 else x[r.integers(len(x))]
    before = None
    for _ in range(rounds):
        nearest = assign(x, centers, spherical)
        if before is not None and (nearest == before).all():
            break
        before = nearest
        counts = np.bincount(nearest, minlength=lists)
        order = np.argsort(nearest, kind="stable")
        sums = np.zeros((lists, dim))
        full = np.flatnonzero(counts)
        starts = np.cumsum(counts) - counts
        sums[full] = np.add.reduceat(x[order], starts[full], 0)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[r.integers(len(x), size=lists)])
        if spherical:
            centers = _unit(centers)
        if bits:
            centers = (centers > 0.5).astype(float)
    return centers


def inertia(x: np.ndarray, centers: np.ndarray, spherical: bool = False) -> float:
    """Sum of squared distances to the nearest center."""
    return float((_distances(x, centers, spherical).min(1) ** 2).sum()) if len(x) else 0.0


def davies_bouldin(x: np.ndarray, centers: np.ndarray) -> float:
    """Mean over clusters of the worst ratio of spreads to distance; lower is better. Clusters without rows don't count."""
    nearest = assign(x, centers)
    used = np.unique(nearest)
    if len(used) < 2:
        return 0.0
    spread = np.array([_distances(x[nearest == c], centers[c : c + 1], False).mean() for c in used])
    apart = _distances(centers[used], centers[used], False)
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore"):
        return float(((spread[:, None] + spread[None, :]) / apart).max(1).mean())
