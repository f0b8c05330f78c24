"""Inverted lists: an approximate index of lists around k-means centers.

Build: a bounded sample gives the centers on the driver; every row goes to its nearest center's list in one map;
the table is dealt by list and part, so a list of any size spreads over tasks and files, and sorted, so a scan of a
few lists skips the other row groups (or whole folders, with layout="partitioned"). Search: a query's nearest
`probes` lists are scanned, their rows scored exactly. Inserts append; deletes are remembered and left out until
compact() rewrites the table. Null vectors are not indexed, nor, for cosine, vectors of length 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import BIT, KINDS, SPARSE, VectorError, kind_of
from ..plans.options import build_options, scan_option
from ..shared import share
from ..sources.index_store import Store
from . import kmeans as km
from .knn import QUERY_BYTES, Best, arrow_types, query_blocks, scored_candidates, top_k
from .metrics import batch_of, check_indexable, check_same, metric_of

#: A list of all rows would be dealt in parts of about so many.
PART_ROWS = 2_000_000
#: Most memory of the broadcast centers, in bytes.
CENTER_BYTES = 256 << 20


def _points(batch) -> np.ndarray:
    """Vectors as rows of doubles; bits as zeros and ones."""
    if batch.form == "bit":
        if not len(batch):
            return np.zeros((0, 0))
        bits = np.unpackbits(batch.words.astype(">u8").view(np.uint8).reshape(len(batch), -1), axis=1)
        return bits[:, : int(batch.nbits[0])].astype(float)
    return batch.values


def _dims(df: DataFrame, v: str) -> int | None:
    kind, dim = kind_of(df, v)
    if dim is not None:
        return dim
    size = F.col(v)["nbits"] if kind is BIT else F.size(v)
    row = df.where(F.col(v).isNotNull()).agg(F.min(size).alias("a"), F.max(size).alias("b")).first()
    if row["a"] is not None and row["a"] != row["b"]:
        raise VectorError("column does not have dimensions")
    return row["a"]


class IvfIndex:
    method = "ivf"

    def __init__(self, store: Store, meta: dict, centers: np.ndarray):
        self.store, self.meta, self.centers = store, meta, centers
        self.kind, self.metric = KINDS[meta["kind"]], metric_of(meta["metric"], KINDS[meta["kind"]])

    @property
    def lists(self) -> int:
        return len(self.centers)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @classmethod
    def build(cls, df: DataFrame, v: str = "embedding", key: str = "vec_id", metric: str = "l2", lists: int | None = None, path: str | None = None, seed: int = 0, layout: str = "sorted") -> IvfIndex:
        spark = df.sparkSession
        lists = build_options("ivf", lists=lists)["lists"]
        kind = kind_of(df, v)[0]
        if kind is SPARSE:
            raise VectorError("no operator class of ivf for sparsevec")
        scorer, dim = metric_of(metric, kind), _dims(df, v)
        check_indexable("ivf", kind, metric, dim if dim is not None else 3)
        rows = df.where(F.col(v).isNotNull()).select(F.col(key).alias("key"), F.col(v).alias("vec"))
        spark.sparkContext.setJobDescription("ivf: performing k-means")
        wanted = km.sample_size(lists)
        total = rows.count()
        slots = 1 << 30
        share = min(1.0, 1.2 * wanted / max(1, total))
        sample = rows.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(slots)) <= int(share * slots)).select("vec").limit(wanted).toArrow().column("vec")
        points = _points(batch_of(sample, kind)) if len(sample) else np.zeros((0, dim or 3))
        if scorer.unit and len(points):
            points = points[(points**2).sum(1) > 0]
        centers = km.kmeans(points, lists, scorer.spherical, kind is BIT, seed)
        meta = {"kind": kind.name, "metric": metric, "key": key, "dim": dim, "layout": layout, "version": 0, "changes": 1, "seed": seed, "parts": -(-max(1, total) // PART_ROWS), "vec": df.schema[v].dataType.simpleString(), "key_type": df.schema[key].dataType.simpleString(), "few_samples": len(points) < lists}
        if centers.nbytes > CENTER_BYTES:
            raise VectorError(f"centers take {centers.nbytes >> 20} MB, limit is {CENTER_BYTES >> 20} MB")
        index = cls(Store(spark, path), meta, centers)
        spark.sparkContext.setJobDescription("ivf: assigning and loading rows")
        index.store.write(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list_id int, center array<double>"), "centers")
        index._append(rows, 1)
        index.store.save_meta(meta)
        spark.sparkContext.setJobDescription(None)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        store = Store(spark, path)
        rows = store.table("centers").orderBy("list_id").collect()  # as many as the build allows lists
        return cls(store, store.load_meta(), np.array([r.center for r in rows]))

    def _assigned(self, rows: DataFrame) -> DataFrame:
        shared, kind, metric = share(self.spark, self.centers), self.kind, self.metric
        key, vec = rows.schema["key"], rows.schema["vec"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    points = _points(batch_of(batch.column("vec"), kind))
                    if points.shape[1] != shared.value.shape[1]:
                        raise VectorError(f"expected {shared.value.shape[1]} dimensions, not {points.shape[1]}")
                    keep = (points**2).sum(1) > 0 if metric.unit else np.ones(len(points), bool)
                    near = km.assign(points, shared.value, metric.spherical).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(near), batch.column("key"), batch.column("vec")], ["list_id", "key", "vec"]).filter(pa.array(keep))

        return rows.mapInArrow(run, f"list_id int, key {key.dataType.simpleString()}, vec {vec.dataType.simpleString()}")

    def _entries_name(self) -> str:
        return f"entries-{self.meta['version']}"

    def _append(self, rows: DataFrame, number: int) -> None:
        self._write(self._assigned(rows), number)

    def _write(self, assigned: DataFrame, number: int) -> None:
        """Deals rows by list, a large list in several parts; unlike ranges this needs no pass to find bounds."""
        part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(self.meta["parts"]))
        writer = assigned.repartition("list_id", part).sortWithinPartitions("list_id").write.mode("overwrite")
        (writer.partitionBy("list_id") if self.meta["layout"] == "partitioned" else writer).parquet(f"{self.store.path}/{self._entries_name()}/change={number}")

    def entries(self) -> DataFrame:
        """list_id, key, vec of every row that is indexed and not deleted."""
        found = self.store.changes(self._entries_name(), self.meta["changes"])
        return self.store.live(found, self.meta).select("list_id", "key", "vec")

    def insert(self, df: DataFrame, v: str = "embedding", key: str | None = None, commit: bool = True) -> None:
        """Appends rows to their lists; centers stay. What isn't committed doesn't count, and is written over by the next change after load()."""
        self.meta["changes"] += 1
        self._append(df.where(F.col(v).isNotNull()).select(F.col(key or self.meta["key"]).alias("key"), F.col(v).alias("vec")), self.meta["changes"])
        if commit:
            self.store.save_meta(self.meta)

    def delete(self, keys: DataFrame, key: str | None = None, commit: bool = True) -> None:
        """Hides the rows of these keys that are there by now; rows inserted later are found."""
        self.store.delete(keys.select(F.col(key or self.meta["key"]).alias("key")), self.meta, commit)

    def compact(self) -> None:
        """Rewrites the table without deleted rows."""
        live = self.entries()
        self.meta |= {"version": self.meta["version"] + 1, "changes": 1}
        self._write(live, 1)
        self.store.save_meta(self.meta)

    def stats(self) -> DataFrame:
        """list_id and its rows."""
        return self.entries().groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows"))

    def quality(self, sample: int = 10_000) -> dict[str, float]:
        """Inertia and Davies-Bouldin index over at most `sample` rows."""
        points = _points(batch_of(self.entries().select("vec").limit(sample).toArrow().column("vec"), self.kind))
        return {"inertia": km.inertia(km._unit(points) if self.metric.spherical else points, self.centers, self.metric.spherical), "davies_bouldin": km.davies_bouldin(points, self.centers)}

    def _order(self, queries) -> np.ndarray:
        """For each query the lists from the nearest on."""
        points = _points(queries)
        return np.argsort(km._distances(km._unit(points) if self.metric.spherical else points, self.centers, self.metric.spherical), 1, kind="stable")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, iterative: str | None = None, max_probes: int | None = None, v: str = "embedding", key: str | None = None, allowed: DataFrame | None = None, mode: str = "pre", out: str = "distance", query: str = "query_id", limit: int = QUERY_BYTES) -> DataFrame:
        """query_id, key, distance and rank of each query's nearest rows among its probed lists.

        allowed: keys that may be found. Whether a filter comes before the scoring of a list or after, the same rows
        are left, so both modes score only them; iterative="relaxed_order" goes on with the next lists until a query
        has k rows or max_probes lists are read.
        """
        spark = self.spark
        probes = min(scan_option(spark, "ivfflat.probes", probes), self.lists)
        iterative = scan_option(spark, "ivfflat.iterative_scan", iterative)
        most = min(max(probes, scan_option(spark, "ivfflat.max_probes", max_probes)), self.lists) if iterative != "off" else probes
        entries = self.entries()
        keys = None if allowed is None else allowed.select(F.col(self.meta["key"]).alias("key")).distinct()
        if keys is not None:
            entries = entries.join(keys, "key", "left_semi")
        found = None
        key = key or self.meta["key"]
        for block in query_blocks(queries, v, key, limit):
            part = self._search_block(block, queries.schema[key].dataType.simpleString(), entries, k, probes, most, query, out)
            found = part if found is None else found.unionByName(part)
        return top_k(found, k, query, self.meta["key"], out)

    def nearest_to(self, query: list[float] | None, k: int, out: str = "distance", **options) -> DataFrame:
        """key and distance of the k rows nearest to one dense query; a null query is at distance 0 from every row, in no order."""
        key = self.meta["key"]
        if query is None:
            return self.entries().limit(k).select(F.col("key").alias(key), F.lit(0.0).alias(out))
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "_id int, _vector array<float>")
        return self.search(asked, k, v="_vector", key="_id", out=out, **options).orderBy("rank").select(key, out)

    def _search_block(self, block: pa.Table, query_type: str, entries: DataFrame, k: int, probes: int, most: int, query: str, out: str) -> DataFrame:
        names, kind, own_key = block.column("_q").to_pylist(), self.kind, self.meta["key"]
        asked = batch_of(block.column("_v"), kind)
        if len(asked) and _points(asked).shape[1] != self.centers.shape[1]:
            raise VectorError(f"different {kind.name} dimensions {self.centers.shape[1]} and {_points(asked).shape[1]}")
        order = self._order(asked) if len(asked) else np.zeros((0, self.lists), np.int64)
        schema = f"{query} {query_type}, {own_key} {self.meta['key_type']}, {out} double"
        live, at, found = np.arange(len(names)), 0, None
        while True:
            until = min(most, at + probes)
            wanted = {int(c): [] for c in np.unique(order[live, at:until])}
            for q in live.tolist():
                for c in order[q, at:until].tolist():
                    wanted[c].append(q)
            shared = share(self.spark, (names, asked, {c: np.array(q) for c, q in wanted.items()}))
            rows = entries if len(wanted) >= self.lists else entries.where(F.col("list_id").isin(sorted(wanted)))
            part = rows.mapInArrow(_scanner(shared, kind, self.metric, k, (query, own_key, out), arrow_types(query_type, self.meta["key_type"])), schema)
            found = part if found is None else found.unionByName(part)
            at = until
            if at >= most or not len(live):
                return found
            # one row a query at most comes to the driver
            counts = {r[0]: r[1] for r in found.groupBy(query).agg(F.count(F.lit(1))).collect()}
            live = np.array([q for q in live.tolist() if counts.get(names[q], 0) < k], np.int64)
            if not len(live):
                return found


def _scanner(shared, kind, metric, k: int, columns: tuple[str, str, str], types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, wanted = shared.value
        best = Best(k, len(asked))
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("list_id").to_numpy()
            order = np.argsort(lists, kind="stable")
            cuts = np.flatnonzero(np.diff(lists[order])) + 1
            whole = batch_of(batch.column("vec"), kind)
            check_same(asked, whole, kind)
            keys = np.array(batch.column("key").to_pylist())
            for part in np.split(order, cuts):
                queries = wanted.get(int(lists[part[0]]))
                if queries is None:
                    continue
                scored_candidates(asked, whole.take(part), keys[part], metric, best, queries)
        for query, distance, key in best:
            yield _rows(names, query, key, distance, columns, types)

    return run


def _rows(names: list, query: np.ndarray, key: np.ndarray, distance: np.ndarray, columns: tuple[str, str, str], types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in query.tolist()], types[0]), pa.array(key.tolist(), types[1]), pa.array(distance, pa.float64())], list(columns))
