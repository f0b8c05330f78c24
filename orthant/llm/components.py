"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import checkpoint, map_arrow

#: Links that a task contracts at a time.
PORTION = 1_000_000
#: Links, contracted by the tasks that found them, that one task finishes; more go by rounds.
SMALL = 50_000


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the links a[i] - b[i] reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (u, v) -> links of each node to the least that it reaches, portion by portion."""

    def contract(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        kept = pa.Table.from_batches(held).combine_chunks()
        n = kept.num_rows
        both = pa.chunked_array([*kept.column("u").chunks, *kept.column("v").chunks]).combine_chunks().dictionary_encode()
        both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
        order = pc.sort_indices(both.dictionary).to_numpy()
        values = both.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[both.indices.to_numpy(zero_copy_only=False)]
        label = least_reached(codes[:n], codes[n:], len(order))
        nodes = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([values.take(pa.array(nodes)), values.take(pa.array(label[nodes]))], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= PORTION:
            yield contract(held)
            held, size = [], 0
    if held:
        yield contract(held)


def components(links: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, kind: str = "", more: DataFrame | None = None) -> DataFrame:
    """links (a, b) of one orderable type -> node, component: the least node that it reaches, for every node of a link.

    With run, `links` are rows from whose batches it makes the links, of Spark's type `kind` and without nulls; the same
    Python worker contracts them, where two maps in a row would hold two workers a task. more: further links (a, b).

    Tasks first contract what links they hold to stars around their least nodes. Up to SMALL links that are left go to
    one task. For more, alternating large-star and small-star steps do the rest: every step replaces links by links to a least neighbour, and after a few (the logarithm of the
    largest diameter, about) all nodes of a component point at its least. Least neighbours are partial aggregates; a
    hub's links are split by the skew join. Every round is checkpointed, so a lost executor costs one round at most.
    Nulls and loops are ignored.
    """
    kind = kind or links.schema["a"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    straight = lambda df: df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if run is None:
        edges = map_arrow(straight(links), _stars, schema)
    else:
        edges = map_arrow(links, lambda it: _stars(pa.RecordBatch.from_arrays(batch.columns, ["u", "v"]) for batch in run(it)), schema)
    if more is not None:
        edges = edges.unionByName(straight(more))
    edges = checkpoint(edges.distinct())
    small = edges.count() <= SMALL
    if small:
        edges = checkpoint(map_arrow(edges.repartition(1), _stars, schema))
    while not small:
        one, zero = F.lit(1), F.lit(0)
        roles = edges.select(F.col("u").alias("x"), one.alias("up"), zero.alias("down")).unionByName(edges.select(F.col("v").alias("x"), zero.alias("up"), one.alias("down")))
        if roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        above = edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = edges.join(above, edges["v"] == above["x"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        nearer = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(nearer.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
