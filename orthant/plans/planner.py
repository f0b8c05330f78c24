"""Choice between an exact scan and an index, by the share of rows that a scan would touch."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Share of rows beyond which reading all of them is cheaper.
EXACT_BEYOND = 0.5


def ivf_ratio(probes: int, lists: int) -> float:
    return min(1.0, probes / max(1, lists))


def hnsw_ratio(rows: int, m: int, ef_search: int) -> float:
    """Share of a graph's elements that a search visits, about."""
    if rows <= 1:
        return 1.0
    entry = int(math.log(rows) / math.log(m))
    part = 0.55 * math.log(rows) / (math.log(m) * (1 + math.log(ef_search)))
    return min(1.0, (entry * m + 2 * m * ef_search * part) / rows)


@dataclass(frozen=True)
class Choice:
    use_index: bool
    ratio: float
    why: str


def choose(rows: int, index=None, ordered: bool = True, limit: int | None = None, probes: int = 1, ef_search: int = 40, use_index: bool | None = None) -> Choice:
    """Whether to use the index for an ORDER BY distance LIMIT k; index: an IvfIndex, an HnswIndex or None."""
    if index is None:
        return Choice(False, 1.0, "no index")
    if not ordered or limit is None:
        return Choice(False, math.inf, "an index answers only ORDER BY distance LIMIT k")
    ratio = ivf_ratio(probes, index.lists) if index.method == "ivf" else hnsw_ratio(rows, index.m, ef_search)
    if use_index is not None:
        return Choice(use_index, ratio, "as asked")
    if ratio > EXACT_BEYOND:
        return Choice(False, ratio, "the index would touch most rows")
    return Choice(True, ratio, "the index touches few rows")
