"""Metrics: for each a Column expression that defines it and numpy kernels for batches.

`near` gives a whole matrix quickly (matrix products), good to choose candidates by; `exact` scores chosen pairs
with the expression's own arithmetic, so results agree with it bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions import expr
from ..functions.kinds import BIT, SPARSE, Kind, VectorError


#: Rows of a block of differences, which stays in a core's cache.
L1_ROWS = 512


class DenseBatch:
    form = "dense"  # classes travel by value, so copies of them differ; forms do not

    def __init__(self, values: np.ndarray):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def take(self, which) -> DenseBatch:
        return DenseBatch(self.values[which])

    def unit(self) -> tuple[DenseBatch, np.ndarray]:
        """Vectors of length 1, single precision as they would be stored, and whether each has a length."""
        norms = np.sqrt((self.values**2).sum(1))
        fine = norms > 0
        return DenseBatch((self.values / np.where(fine, norms, 1)[:, None]).astype(np.float32).astype(np.float64)), fine


class SparseBatch:
    form = "sparse"

    def __init__(self, dim: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.dim, self.rows = dim, rows

    def __len__(self) -> int:
        return len(self.rows)

    def take(self, which) -> SparseBatch:
        which = np.flatnonzero(which) if np.asarray(which).dtype == bool else np.asarray(which)
        return SparseBatch(self.dim[which], [self.rows[i] for i in which.tolist()])

    def unit(self) -> tuple[SparseBatch, np.ndarray]:
        norms = np.array([np.sqrt((v**2).sum()) for _, v in self.rows])
        fine = norms > 0
        return SparseBatch(self.dim, [(i, (v / (n or 1)).astype(np.float32).astype(np.float64)) for (i, v), n in zip(self.rows, norms)]), fine


class BitBatch:
    form = "bit"

    def __init__(self, nbits: np.ndarray, words: np.ndarray):
        self.nbits, self.words = nbits, words

    def __len__(self) -> int:
        return len(self.words)

    def take(self, which) -> BitBatch:
        return BitBatch(self.nbits[which], self.words[which])

    def unit(self) -> tuple[BitBatch, np.ndarray]:
        return self, np.ones(len(self), bool)


def batch_of(array: pa.Array, kind: Kind):
    """An Arrow column without nulls as a batch; its vectors must agree in length."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if kind is SPARSE:
        rows = [(np.array(r["indices"], np.int64), np.array(r["values"], np.float64)) for r in array.to_pylist()]
        batch = SparseBatch(np.array([r["dim"] for r in array.to_pylist()], np.int64), rows)
        sizes = batch.dim
    elif kind is BIT:
        sizes = array.field("nbits").to_numpy(zero_copy_only=False).astype(np.int64)
        words = array.field("words")
        width = int(-(-sizes.max() // 64)) if len(sizes) else 0
        if len(set(sizes.tolist())) > 1:
            raise VectorError(f"different bit lengths {sizes[0]} and {sizes[sizes != sizes[0]][0]}")
        return BitBatch(sizes, words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(sizes), width))
    else:
        sizes = np.diff(array.offsets.to_numpy()) if len(array) else np.empty(0, np.int64)
        flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(set(sizes.tolist())) <= 1:
            return DenseBatch(flat.reshape(len(sizes), int(sizes[0]) if len(sizes) else 0))
    if len(set(sizes.tolist())) > 1:
        raise VectorError(f"different {kind.name} dimensions {sizes[0]} and {sizes[sizes != sizes[0]][0]}")
    return batch


def check_same(a, b, kind: Kind) -> None:
    one = lambda x: int(x.nbits[0]) if kind is BIT else int(x.dim[0]) if kind is SPARSE else x.values.shape[1]
    if len(a) and len(b) and one(a) != one(b):
        raise VectorError(f"different {'bit lengths' if kind is BIT else kind.name + ' dimensions'} {one(b)} and {one(a)}")


def _fold(terms: np.ndarray) -> np.ndarray:
    """Sums from the first element on, rounded once to single precision."""
    if terms.shape[1] == 0:
        return np.zeros(len(terms))
    with np.errstate(over="ignore"):
        return np.add.accumulate(terms, 1)[:, -1].astype(np.float32).astype(np.float64)


def _aligned(x: SparseBatch, y: SparseBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    left, right = [], []
    for (i, v), (j, w) in zip(x.rows, y.rows):
        keys = np.union1d(i, j)
        a, b = np.zeros(len(keys)), np.zeros(len(keys))
        a[np.searchsorted(keys, i)], b[np.searchsorted(keys, j)] = v, w
        left.append(a)
        right.append(b)
    return left, right


def _pairs(x, y, f) -> np.ndarray:
    if x.form == "sparse":
        return np.array([_fold(f(a, b)[None, :])[0] for a, b in zip(*_aligned(x, y))])
    return _fold(f(x.values, y.values))


def dense_of(x: SparseBatch, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(columns)))
    if len(x):
        row = np.repeat(np.arange(len(x)), [len(i) for i, _ in x.rows])
        out[row, np.searchsorted(columns, np.concatenate([i for i, _ in x.rows]))] = np.concatenate([v for _, v in x.rows])
    return out


def _matrices(q, x) -> tuple[np.ndarray, np.ndarray]:
    if q.form == "sparse":
        every = [i for i, _ in q.rows] + [i for i, _ in x.rows]
        columns = np.unique(np.concatenate(every)) if every else np.empty(0, np.int64)
        return dense_of(q, columns), dense_of(x, columns)
    return q.values, x.values


def _near_l2(q, x) -> np.ndarray:
    a, b = _matrices(q, x)
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def _near_ip(q, x) -> np.ndarray:
    a, b = _matrices(q, x)
    return -(a @ b.T)


def _near_cosine(q, x) -> np.ndarray:
    a, b = _matrices(q, x)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip(a @ b.T / np.sqrt((a**2).sum(1)[:, None] * (b**2).sum(1)[None, :]), -1, 1)


def _near_l1(q, x) -> np.ndarray:
    a, b = _matrices(q, x)
    out, ones = np.empty((len(a), len(b))), np.ones(b.shape[1])
    for at in range(0, len(b), L1_ROWS):
        part = b[at : at + L1_ROWS]
        apart = np.empty_like(part)
        for row, to in zip(a, out):
            np.dot(np.abs(np.subtract(part, row, out=apart), out=apart), ones, out=to[at : at + L1_ROWS])
    return out


def _exact_cosine(q, x) -> np.ndarray:
    dot = _pairs(q, x, lambda a, b: a * b)
    if q.form == "sparse":
        norm = lambda s: np.array([_fold((v * v)[None, :])[0] for _, v in s.rows])
    else:
        norm = lambda s: _fold(s.values * s.values)
    norms = norm(q) * norm(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((norms == 0) | np.isnan(dot / np.sqrt(norms)), np.nan, 1 - np.clip(dot / np.sqrt(norms), -1, 1))


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1, dtype=np.float64)


def _counted(q: BitBatch, x: BitBatch, f: Callable) -> np.ndarray:
    """The bits of f(words of q, words of x) for all pairs, a word at a time."""
    out = np.zeros((len(q), len(x)))
    for a, b in zip(q.words.T, x.words.T):
        out += np.bitwise_count(f(a[:, None], b[None, :]))
    return out


def _hamming(q: BitBatch, x: BitBatch) -> np.ndarray:
    return _counted(q, x, np.bitwise_xor)


def _jaccard_of(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(both == 0, 1.0, 1 - both / (a + b - both))


def _jaccard(q: BitBatch, x: BitBatch) -> np.ndarray:
    return _jaccard_of(_counted(q, x, np.bitwise_and), _ones(q.words)[:, None], _ones(x.words)[None, :])


@dataclass(frozen=True)
class Metric:
    name: str
    column: Callable
    near: Callable
    exact: Callable
    #: whether an index stores vectors of length 1 (and leaves out those without one)
    unit: bool = False
    #: whether k-means works on the sphere
    spherical: bool = False


METRICS = {
    "l2": Metric("l2", expr.l2_distance, _near_l2, lambda q, x: np.sqrt(_pairs(q, x, lambda a, b: (a - b) * (a - b)))),
    "ip": Metric("ip", expr.negative_inner_product, _near_ip, lambda q, x: -_pairs(q, x, lambda a, b: a * b), spherical=True),
    "cosine": Metric("cosine", expr.cosine_distance, _near_cosine, _exact_cosine, unit=True, spherical=True),
    "l1": Metric("l1", expr.l1_distance, _near_l1, lambda q, x: _pairs(q, x, lambda a, b: np.abs(a - b))),
    "hamming": Metric("hamming", lambda a, b, kind=BIT: expr.hamming_distance(a, b), _hamming, lambda q, x: _ones(q.words ^ x.words)),
    "jaccard": Metric("jaccard", lambda a, b, kind=BIT: expr.jaccard_distance(a, b), _jaccard, lambda q, x: _jaccard_of(_ones(q.words & x.words), _ones(q.words), _ones(x.words))),
}

#: What can be indexed by which metric: operator classes by index method.
OPERATOR_CLASSES = {
    "btree": {"vector": ("order",), "halfvec": ("order",), "sparsevec": ("order",)},
    "ivf": {"vector": ("l2", "ip", "cosine"), "halfvec": ("l2", "ip", "cosine"), "bit": ("hamming",)},
    "hnsw": {"vector": ("l2", "ip", "cosine", "l1"), "halfvec": ("l2", "ip", "cosine", "l1"), "bit": ("hamming", "jaccard"), "sparsevec": ("l2", "ip", "cosine", "l1")},
}


def metric_of(name: str, kind: Kind) -> Metric:
    if name not in METRICS:
        raise VectorError(f"unknown metric {name}")
    if (kind is BIT) != (name in ("hamming", "jaccard")):
        raise VectorError(f"metric {name} does not take {kind.name}")
    return METRICS[name]


def check_indexable(method: str, kind: Kind, metric: str, dim: int | None) -> None:
    """The limits of an index: metric, length."""
    if metric not in OPERATOR_CLASSES[method].get(kind.name, ()):
        raise VectorError(f"no operator class of {method} for {kind.name} and {metric}")
    if dim is None or dim < 1:
        raise VectorError("column does not have dimensions")
    if kind is not SPARSE and dim > kind.index_limits[method]:
        raise VectorError(f"column cannot have more than {kind.index_limits[method]} dimensions for {method} index")
    if method == "ivf" and METRICS[metric].spherical and dim == 1:
        raise VectorError("dimensions must be greater than one for this opclass")


