"""Layered graphs: an approximate index of shards, each a graph of bounded size that one task builds or searches.

Rows are dealt by their key into shards of about SHARD_ROWS. A shard's graph has the layers, links and neighbour
choice of a hierarchical navigable small world: an element's candidates are the nearest `ef_construction` of those
before it (exactly, from the shard's distance matrix), a candidate is linked if it is nearer to the element than to
every link chosen so far, pruned ones fill what is left, and links back are cut by the same rule. Equal vectors
share an element, ten keys at most. Every shard is searched and the best of all kept, so recall doesn't fall with
the number of shards. Inserts add shards; deletes are remembered until compact() rebuilds.

A task searches for a block of queries at once, step by step: one matrix product gives their distances to the whole
shard, and each step follows the links of one element for every query. Filters and deletions are worked out before
the scan, as the keys of each shard that may be found, so a task keeps k rows for each query however wide its beam.

Null vectors are not indexed, nor, for cosine, vectors of length 0.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import KINDS, SPARSE, VectorError, kind_of
from ..plans.options import build_options, scan_option
from ..shared import share
from ..sources.index_store import Store
from .ivf import _dims, _rows
from .knn import QUERY_BYTES, TopK, add_exact, arrow_types, candidates, query_blocks, top_k, written
from .metrics import BitBatch, DenseBatch, SparseBatch, batch_of, check_indexable, check_same, dense_of, metric_of

SHARD_ROWS = 1500
#: Files that one build writes at most.
MAX_FILES = 10_000
#: Keys that one element holds.
KEYS = 10
#: Queries that a task searches for at once.
QUERIES = 1024
#: Shards that one part of a filtered scan holds.
SHARDS = 64
#: Most columns in which sparse vectors are laid out densely.
DENSE_COLUMNS = 1024
_MAX_LEVEL = 30
_FAR = np.finfo(np.float64).max


def _choose(distances: np.ndarray, order: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of distance those that no chosen one is nearer to; then pruned ones, up to `most`."""
    nearer = np.packbits(~(among[order[:, None], order] > distances[order][:, None]), 1, bitorder="little")
    chosen, pruned, taken = [], [], 0
    for place, c in enumerate(order.tolist()):
        if len(chosen) == most:
            break
        if int.from_bytes(nearer[place].tobytes(), "little") & taken:
            pruned.append(c)
        else:
            chosen.append(c)
            taken |= 1 << place
    return chosen + pruned[: most - len(chosen)]


def _reached(table: np.ndarray, start: int) -> np.ndarray:
    """Whether links lead from start to each element."""
    n = len(table)
    found = np.zeros(n + 1, bool)
    found[start] = True
    last = np.array([start])
    while len(last):
        new = np.unique(table[last])
        last = new[~found[new] & (new < n)]
        found[last] = True
    return found[:n]


def _beam(table: np.ndarray, near: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
    """Elements that a beam of ef finds in one layer, for each query; -1 where there are fewer. near: distances to every element.

    Each query goes on from the nearest element that it has not gone on from (of equal ones the first), until that is
    farther than all of a full beam; an element enters a full beam if it is nearer than the farthest, of which the
    first leaves.
    """
    queries, n = near.shape
    row = np.arange(queries)
    seen = np.zeros((queries, n + 1), bool)
    seen[:, n] = seen[row, start] = True
    best, element = np.full((queries, ef), -np.inf), np.full((queries, ef), -1)
    todo = np.full((queries, ef), np.inf)  # the beam's distances, where it has not gone on from there
    left = np.full((queries, n), np.inf)  # elements that left the beam before that; those as near as the farthest still count
    best[:, 0] = todo[:, 0] = near[row, start]
    element[:, 0], count = start, np.ones(queries, np.int64)
    worst = np.full(queries, np.inf) if ef > 1 else best[:, 0].copy()
    live = row
    while len(live):
        own = todo[live]
        distance = own.min(1)
        slot = np.where(own == distance[:, None], element[live], n).argmin(1)
        at = element[live, slot]
        out = np.flatnonzero(distance >= worst[live])
        others = left[live[out]]
        other = others.argmin(1)
        apart = others[np.arange(len(out)), other]
        sooner = (apart < distance[out]) | (apart == distance[out]) & (other < at[out])
        out, other = out[sooner], other[sooner]
        distance[out], at[out] = apart[sooner], other
        go = (distance <= worst[live]) & (distance < np.inf)
        inside = go.copy()
        inside[out] = False
        todo[live[inside], slot[inside]] = np.inf
        left[live[out], other] = np.inf
        live, to = live[go], table[at[go]]
        fresh = ~seen[live[:, None], to]
        seen[live[:, None], to] = True
        distance = near[live[:, None], np.minimum(to, n - 1)]
        r, p = np.nonzero(fresh & (distance < worst[live][:, None]))
        turn = np.arange(len(r)) - np.searchsorted(r, r)  # in the order of the links, one a query at a time
        order = np.argsort(turn, kind="stable")
        r, p = r[order], p[order]
        asking, entering, apart = live[r], to[r, p], distance[r, p]
        ends = np.cumsum(np.bincount(turn)).tolist() if len(r) else []
        for a, b in zip([0, *ends], ends):
            q, e, d = asking[a:b], entering[a:b], apart[a:b]
            enters = d < worst[q]
            q, e, d = q[enters], e[enters], d[enters]
            place, full = count[q], count[q] == ef
            if full.any():
                who = q[full]
                place[full] = where = np.where(best[who] == worst[who][:, None], element[who], n).argmin(1)
                left[who, element[who, where]] = todo[who, where]
            best[q, place] = todo[q, place] = d
            element[q, place] = e
            count[q] += ~full
            full = q[count[q] == ef]
            worst[full] = best[full].max(1)
    return element


class Graph:
    """keys[i]: an element's keys; links[layer][i]: its neighbours; element 0 of the highest level is where searches start."""

    def __init__(self, batch, keys: list[list], levels: np.ndarray, links: list[dict[int, list[int]]], entry: int):
        self.batch, self.keys, self.levels, self.links, self.entry = batch, keys, levels, links, entry

    @classmethod
    def build(cls, batch, keys: np.ndarray, metric, m: int, ef: int, seed: int) -> Graph:
        first: dict[bytes, list[int]] = {}
        elements, held = [], []
        for i in range(len(batch)):
            one = _bytes_of(batch, i)
            same = first.setdefault(one, [])
            if same and len(held[same[-1]]) < KEYS:
                held[same[-1]].append(keys[i])
            else:
                same.append(len(elements))
                elements.append(i)
                held.append([keys[i]])
        batch = batch.take(np.array(elements, np.int64))
        n = len(batch)
        r = np.random.default_rng(seed)
        levels = np.minimum(np.floor(-np.log(1 - r.random(n)) / np.log(m)), _MAX_LEVEL).astype(np.int64)
        source = batch.unit()[0] if metric.unit else batch
        near = np.vstack([metric.near(source.take(np.arange(a, min(n, a + 512))), source) for a in range(0, n, 512)]) if n else np.zeros((0, 0))
        near = np.where(np.isnan(near), np.inf, near)
        top = int(levels.max()) if n else 0
        links: list[dict[int, list[int]]] = [{} for _ in range(top + 1)]
        for layer in range(top + 1):
            most = 2 * m if layer == 0 else m
            own = links[layer]
            members = np.flatnonzero(levels >= layer)
            for place, i in enumerate(members.tolist()):
                before = members[:place]
                row = near[i]
                if len(before) > ef:
                    before = before[np.argpartition(row[before], ef - 1)[:ef]]
                order = before[np.argsort(row[before], kind="stable")]
                own[i] = _choose(row, order, near, m)
                for j in own[i]:
                    back = own[j]
                    back.append(i)
                    if len(back) > most:
                        links_of = np.array(back)
                        own[j] = _choose(near[j], links_of[np.argsort(near[j][links_of], kind="stable")], near, most)
        return cls(batch, held, levels, links, int(levels.argmax()) if n else -1)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each layer its elements and, a row for each, the places of those it links to, filled up with their number."""
        made = []
        for layer, own in enumerate(self.links):
            members = np.flatnonzero(self.levels >= layer)
            table = np.full((len(members), max([1, *map(len, own.values())])), len(members))
            for place, i in enumerate(members.tolist()):
                table[place, : len(own[i])] = np.searchsorted(members, own[i])
            made.append((members, table))
        return made

    def found(self, near: np.ndarray, ef: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """For each of a block of queries the elements that a beam of ef finds, and their distances, infinite where there are fewer. near: distances to every element."""
        queries, n = near.shape
        near = np.where(near < _FAR, near, _FAR)
        start = np.full(queries, self.entry)
        for members, table in tables[:0:-1]:
            if len(members) > 1:
                start = members[_beam(table, near[:, members], np.searchsorted(members, start), 1)[:, 0]]
        table = tables[0][1]
        if ef >= n:  # the beam never fills before all that links lead to is in it
            for i in np.unique(start).tolist():
                near[np.ix_(start == i, ~_reached(table, i))] = np.inf
            return np.broadcast_to(np.arange(n), near.shape), near
        element = _beam(table, near, start, ef)
        return element, np.where(element < 0, np.inf, near[np.arange(queries)[:, None], element])

    def search(self, query, metric, ef: int) -> list[int]:
        """Elements from the nearest on, ef at most."""
        if self.entry < 0:
            return []
        element, near = self.found(metric.near(query, self.batch), ef, self.tables())
        return [int(element[0, i]) for i in np.lexsort((element[0], near[0])) if near[0, i] < np.inf]

    def pack(self) -> bytes:
        arrays = {"levels": self.levels, "entry": np.array([self.entry]), "keys": np.array([k for x in self.keys for k in x]), "key_counts": np.array([len(x) for x in self.keys])}
        b = self.batch
        if b.form == "dense":
            arrays["values"] = b.values.astype(np.float32)
        elif b.form == "bit":
            arrays |= {"nbits": b.nbits, "words": b.words}
        else:
            arrays |= {"dim": b.dim, "indices": np.concatenate([np.empty(0, np.int64), *(i for i, _ in b.rows)]), "entries": np.concatenate([np.empty(0), *(v for _, v in b.rows)]), "counts": np.array([len(i) for i, _ in b.rows])}
        arrays["layers"] = np.array([len(self.links)])
        for layer, own in enumerate(self.links):
            nodes = sorted(own)
            arrays[f"nodes{layer}"] = np.array(nodes, np.int64)
            arrays[f"sizes{layer}"] = np.array([len(own[i]) for i in nodes], np.int64)
            arrays[f"links{layer}"] = np.array([j for i in nodes for j in own[i]], np.int64)
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data), allow_pickle=False) as packed:
            a = dict(packed)  # an array is read anew each time it is asked for
        if "values" in a:
            batch = DenseBatch(a["values"].astype(np.float64))
        elif "words" in a:
            batch = BitBatch(a["nbits"], a["words"])
        else:
            ends = np.cumsum(a["counts"])
            batch = SparseBatch(a["dim"], [(a["indices"][e - c : e], a["entries"][e - c : e]) for e, c in zip(ends.tolist(), a["counts"].tolist())])
        split = lambda flat, counts: [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []
        links = [dict(zip(a[f"nodes{n}"].tolist(), split(a[f"links{n}"], a[f"sizes{n}"]))) for n in range(int(a["layers"][0]))]
        return cls(batch, split(a["keys"], a["key_counts"]), a["levels"], links, int(a["entry"][0]))


def _bytes_of(batch, i: int) -> bytes:
    if batch.form == "dense":
        return batch.values[i].tobytes()
    if batch.form == "bit":
        return batch.words[i].tobytes()
    return batch.rows[i][0].tobytes() + batch.rows[i][1].tobytes()


class HnswIndex:
    method = "hnsw"

    def __init__(self, store: Store, meta: dict):
        self.store, self.meta = store, meta
        self.kind, self.m, self.ef_construction = KINDS[meta["kind"]], meta["m"], meta["ef_construction"]
        self.metric = metric_of(meta["metric"], self.kind)

    @classmethod
    def build(cls, df: DataFrame, v: str = "embedding", key: str = "vec_id", metric: str = "l2", m: int | None = None, ef_construction: int | None = None, path: str | None = None, seed: int = 0, shard_rows: int = SHARD_ROWS) -> HnswIndex:
        options = build_options("hnsw", m=m, ef_construction=ef_construction)
        kind = kind_of(df, v)[0]
        metric_of(metric, kind)
        dim = None if kind is SPARSE else _dims(df, v)
        check_indexable("hnsw", kind, metric, dim if dim is not None else 3)
        types = {"key_type": df.schema[key].dataType.simpleString(), "vec": df.schema[v].dataType.simpleString()}
        meta = {"kind": kind.name, "metric": metric, "key": key, "dim": dim, "version": 0, "changes": 1, "seed": seed, "shard_rows": shard_rows, **options, **types}
        index = cls(Store(df.sparkSession, path), meta)
        index._append(df.where(F.col(v).isNotNull()).select(F.col(key).alias("key"), F.col(v).alias("vec")), 1)
        index.store.save_meta(meta)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HnswIndex:
        store = Store(spark, path)
        return cls(store, store.load_meta())

    def _append(self, rows: DataFrame, number: int) -> None:
        kind, metric, m, ef, seed = self.kind, self.metric, self.m, self.ef_construction, self.meta["seed"]
        shards = max(1, -(-rows.count() // self.meta["shard_rows"]))
        limit = kind.index_limits["hnsw"]

        def build(frame: pa.Table) -> pa.Table:
            batch = batch_of(frame.column("vec"), kind)
            if kind is SPARSE and any(len(i) > limit for i, _ in batch.rows):
                raise VectorError(f"sparsevec cannot have more than {limit} non-zero elements for hnsw index")
            keep = batch.unit()[1] if metric.unit else np.ones(len(batch), bool)
            keys = np.array(frame.column("key").to_pylist())[keep]
            graph = Graph.build(batch.take(keep), keys, metric, m, ef, seed)
            return pa.table({"shard": frame.column("shard").slice(0, 1), "n": pa.array([len(keys)], pa.int64()), "payload": pa.array([graph.pack()], pa.binary())})

        # a partition, and so a file, for each shard (of very many shards several share one), so searches read them in parallel
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(shards))).repartition(min(shards, MAX_FILES), "shard")
        made = dealt.groupBy("shard").applyInArrow(build, "shard bigint, n bigint, payload binary")
        context = self.store.spark.sparkContext
        context.setJobDescription("hnsw: loading rows")
        self.store.write(made, f"shards-{self.meta['version']}/change={number}", "overwrite")
        context.setJobDescription(None)

    def insert(self, df: DataFrame, v: str = "embedding", key: str | None = None, commit: bool = True) -> None:
        """New rows in new shards. What isn't committed doesn't count, and is written over by the next change after load()."""
        self.meta["changes"] += 1
        self._append(df.where(F.col(v).isNotNull()).select(F.col(key or self.meta["key"]).alias("key"), F.col(v).alias("vec")), self.meta["changes"])
        if commit:
            self.store.save_meta(self.meta)

    def delete(self, keys: DataFrame, key: str | None = None, commit: bool = True) -> None:
        """Hides the rows of these keys that are there by now; rows inserted later are found."""
        self.store.delete(keys.select(F.col(key or self.meta["key"]).alias("key")), self.meta, commit)

    def _shards(self) -> DataFrame:
        found = self.store.changes(f"shards-{self.meta['version']}", self.meta["changes"])
        return found if "shard" in found.columns else found.withColumn("shard", F.xxhash64("payload"))

    def _scanned(self, allowed: DataFrame | None) -> DataFrame:
        """The shards' payloads; where some keys are deleted or not allowed, those shards that hold others, with these."""
        shards = self._shards().select("change", "shard", "payload")
        if allowed is None and not self.store.deletes(self.meta):
            return shards.select("payload")
        key_type = arrow_types(self.meta["key_type"])[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for change, shard, payload in zip(*(batch.column(c) for c in ("change", "shard", "payload"))):
                    keys = pa.array(np.load(io.BytesIO(payload.as_py()), allow_pickle=False)["keys"].tolist(), key_type)
                    yield pa.RecordBatch.from_arrays([pa.array([change.as_py()] * len(keys), pa.int32()), pa.array([shard.as_py()] * len(keys), pa.int64()), keys], ["change", "shard", "key"])

        keys = self.store.live(shards.mapInArrow(run, f"change int, shard bigint, key {self.meta['key_type']}"), self.meta)
        if allowed is not None:
            keys = keys.join(allowed, "key", "left_semi")
        kept = keys.groupBy("change", "shard").agg(F.collect_list("key").alias("keys"))
        parts = max(3 * self.store.spark.sparkContext.defaultParallelism, -(-shards.count() // SHARDS))
        return shards.repartition(parts, "change", "shard").join(kept, ["change", "shard"]).select("payload", "keys")

    def rows(self) -> DataFrame:
        """key and vec of every row that is indexed and not deleted."""
        kind = self.kind

        key_type = arrow_types(self.meta["key_type"])[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload, change in zip(batch.column("payload").to_pylist(), batch.column("change").to_pylist()):
                    graph = Graph.unpack(payload)
                    which = [i for i, keys in enumerate(graph.keys) for _ in keys]
                    yield pa.RecordBatch.from_arrays([pa.array([k for keys in graph.keys for k in keys], key_type), _arrow_of(graph.batch, which, kind), pa.array([change] * len(which), pa.int32())], ["key", "vec", "change"])

        found = self._shards().select("payload", "change").mapInArrow(run, f"key {self.meta['key_type']}, vec {self.meta['vec']}, change int")
        return self.store.live(found, self.meta).select("key", "vec")

    def compact(self) -> None:
        """Rebuilds the shards without deleted rows."""
        live = self.rows()
        self.meta |= {"version": self.meta["version"] + 1, "changes": 1}
        self._append(live, 1)
        self.store.save_meta(self.meta)

    def stats(self) -> DataFrame:
        return self._shards().agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n_rows"), F.sum(F.octet_length("payload")).alias("bytes"))

    def search(self, queries: DataFrame, k: int, ef_search: int | None = None, iterative: str | None = None, max_scan_tuples: int | None = None, v: str = "embedding", key: str | None = None, allowed: DataFrame | None = None, out: str = "distance", query: str = "query_id", limit: int = QUERY_BYTES) -> DataFrame:
        """query_id, key, distance and rank of up to k rows for each query; without iteration a shard gives ef_search elements at most.

        allowed: keys that may be found, filtered after the scan. iterative (relaxed_order or strict_order; results are
        in strict order either way) searches again with twice the elements for queries that have under k rows, until
        max_scan_tuples elements.
        """
        spark = self.store.spark
        scan_option(spark, "hnsw.scan_mem_multiplier")
        ef = scan_option(spark, "hnsw.ef_search", ef_search)
        iterative = scan_option(spark, "hnsw.iterative_scan", iterative)
        most = scan_option(spark, "hnsw.max_scan_tuples", max_scan_tuples)
        own_key, key = self.meta["key"], key or self.meta["key"]
        scanned = self._scanned(None if allowed is None else allowed.select(F.col(self.meta["key"]).alias("key")))
        query_type = queries.schema[key].dataType.simpleString()
        found = None
        for block in query_blocks(queries, v, key, limit):
            part = self._search_block(block, query_type, scanned, k, ef, iterative, most, query, out)
            found = part if found is None else found.unionByName(part)
        return top_k(found, k, query, own_key, out)

    def nearest_to(self, query: list[float] | None, k: int, out: str = "distance", **options) -> DataFrame:
        """key and distance of the k rows nearest to one dense query; a null query is at distance 0 from every row, in no order."""
        key = self.meta["key"]
        if query is None:
            return self.rows().limit(k).select(F.col("key").alias(key), F.lit(0.0).alias(out))
        asked = self.store.spark.createDataFrame([(0, [float(x) for x in query])], "_id int, _vector array<float>")
        return self.search(asked, k, v="_vector", key="_id", out=out, **options).orderBy("rank").select(key, out)

    def _search_block(self, block: pa.Table, query_type: str, scanned: DataFrame, k: int, ef: int, iterative: str, most: int, query: str, out: str) -> DataFrame:
        spark, names, own_key = self.store.spark, block.column("_q").to_pylist(), self.meta["key"]
        asked, live = batch_of(block.column("_v"), self.kind), np.arange(len(names))
        schema = f"{query} {query_type}, {own_key} {self.meta['key_type']}, {out} double"
        columns, types = (query, own_key, out), arrow_types(query_type, self.meta["key_type"])
        largest, whole = 0 if iterative == "off" else int(self._shards().agg(F.max("n")).first()[0] or 0), None
        while True:
            shared = share(spark, (names, asked, live))
            part = scanned.mapInArrow(_searcher(shared, self.kind, self.metric, ef, k, columns, types), schema)
            if iterative == "off":
                return part
            part = written(top_k(part, k, query, own_key, out).select(*columns))  # once, as they are counted here and returned
            if ef >= min(most, largest):
                return part if whole is None else whole.unionByName(part)
            # one row a query at most comes to the driver
            enough = part.groupBy(query).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(query)
            done = {r[0] for r in enough.collect()}
            live = np.array([i for i in live.tolist() if names[i] not in done], np.int64)
            if len(live):
                part = part.join(enough, query, "left_semi")
            whole = part if whole is None else whole.unionByName(part)
            if not len(live):
                return whole
            ef = min(ef * 2, max(most, ef), max(largest, ef))


def _laid_out(asked: SparseBatch, rows: SparseBatch):
    """Sparse vectors as dense ones in the columns that either batch has, where those are few; zeros change no sum."""
    columns = np.unique(np.concatenate([np.empty(0, np.int64), *(i for i, _ in asked.rows), *(i for i, _ in rows.rows)]))
    return (DenseBatch(dense_of(asked, columns)), DenseBatch(dense_of(rows, columns))) if len(columns) <= DENSE_COLUMNS else (asked, rows)


def _searcher(shared, kind, metric, ef: int, k: int, columns: tuple[str, str, str], types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, live = shared.value
        best = [TopK(k) for _ in range(0, len(live), QUERIES)]
        for batch in batches:
            for at in range(batch.num_rows):
                graph = Graph.unpack(batch.column("payload")[at].as_py())
                if graph.entry < 0:
                    continue
                check_same(asked, graph.batch, kind)
                keys, counts = np.array([key for own in graph.keys for key in own]), np.array([len(own) for own in graph.keys])
                owner = np.repeat(np.arange(len(counts)), counts)
                if "keys" in batch.schema.names:
                    kept = np.isin(keys, np.array(batch.column("keys")[at].as_py()))
                    keys, owner = keys[kept], owner[kept]
                    counts = np.bincount(owner, minlength=len(counts))
                first, tables = np.cumsum(counts) - counts, graph.tables()
                for n, top in enumerate(best):
                    block, rows = asked.take(live[n * QUERIES : (n + 1) * QUERIES]), graph.batch
                    if kind is SPARSE:
                        block, rows = _laid_out(block, rows)
                    near = metric.near(block.unit()[0], rows.unit()[0]) if metric.unit else metric.near(block, rows)
                    element, near = graph.found(near, ef, tables)
                    near[counts[element] == 0] = np.inf
                    q, place = candidates(near, top.worst(len(near)), k, metric)
                    e = element[q, place]
                    add_exact(block, rows, q, e, metric, top, lambda some, e=e: (np.repeat(some, counts[e[some]]), keys[_spread(first[e[some]], counts[e[some]])]))
        for n, top in enumerate(best):
            if top.key is not None:
                yield _rows(names, live[n * QUERIES + top.query], top.key, top.distance, columns, types)

    return run


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, counts of them."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _arrow_of(batch, which: list[int], kind) -> pa.Array:
    if batch.form == "dense":
        return pa.array([batch.values[i].astype(np.float32).tolist() for i in which], pa.list_(pa.float32()))
    if batch.form == "bit":
        return pa.array([{"nbits": int(batch.nbits[i]), "words": batch.words[i].view(np.int64).tolist()} for i in which], pa.struct([("nbits", pa.int32()), ("words", pa.list_(pa.int64()))]))
    kind_of_row = pa.struct([("dim", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
    return pa.array([{"dim": int(batch.dim[i]), "indices": batch.rows[i][0].tolist(), "values": batch.rows[i][1].tolist()} for i in which], kind_of_row)
