"""Exact nearest neighbours: one query, many queries, ranges, re-ranking, hybrid search, recall.

One query is a plain projection and sort (TakeOrderedAndProject keeps k rows a task). Many queries are broadcast in
blocks of a checked size; each task keeps the k best of its rows for every query by matrix products, scores them
with the defining arithmetic, and only those go to the shuffle that finds each query's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions import expr
from ..functions.kinds import BIT, SPARSE, VECTOR, Kind, kind_of
from ..shared import share
from ..sources.index_store import shared_folder
from .metrics import batch_of, check_same, metric_of

#: Queries that are broadcast at once, in bytes of their vectors.
QUERY_BYTES = 32 << 20
#: Rows of the searched table that a task scores at once, and queries it scores them for.
ROWS = 2048
QUERIES = 512
#: Bytes of the vectors of pairs that are scored exactly at once.
PAIR_BYTES = 4 << 20
#: Up to this length a literal query is unrolled into generated code.
UNROLLED = 512


def literal(values, kind: Kind = VECTOR) -> Column:
    """A query vector as an expression: numbers, (dim, indices, values) or a string of bits."""
    if kind is SPARSE:
        dim, indices, entries = values
        return F.struct(F.lit(dim).alias("dim"), F.array(*map(F.lit, indices)).cast("array<int>").alias("indices"), F.array(*(F.lit(float(x)) for x in entries)).cast("array<float>").alias("values"))
    return expr.bit_from_text(F.lit(values)) if kind is BIT else expr.lit_vector(values)


def distance_to(v: Column | str, query, metric: str = "l2", kind: Kind = VECTOR) -> Column:
    """Distance of a column to one query; short dense queries become straight-line generated code with the same sums."""
    v = expr.column(v)
    if kind in (VECTOR,) and metric in ("l2", "ip", "l1") and not isinstance(query, (Column, str)) and len(query) <= UNROLLED:
        terms = []
        for i, x in enumerate(np.asarray(query, np.float32).astype(float).tolist()):
            y = F.get(v, F.lit(i)).cast("double")
            terms.append((y - x) * (y - x) if metric == "l2" else y * x if metric == "ip" else F.abs(y - x))
        total = F.lit(0.0)
        for t in terms:
            total = total + t
        total = total.cast("float").cast("double")
        value = F.sqrt(total) if metric == "l2" else -total if metric == "ip" else total
        wrong = F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(v).cast("string"), F.lit(f" and {len(query)}"))).cast("double")
        return F.when(F.size(v) != len(query), wrong).otherwise(value)
    return metric_of(metric, kind).column(v, query if isinstance(query, Column) else literal(query, kind), kind)


def nearest(df: DataFrame, query, k: int, v: str = "embedding", key: str = "vec_id", metric: str = "l2", kind: Kind | None = None, out: str = "distance") -> DataFrame:
    """The k rows nearest to one query, with their distance; ties go by key, nulls come last. Filters of df come first."""
    kind = kind or kind_of(df, v)[0]
    return df.withColumn(out, distance_to(v, query, metric, kind)).orderBy(F.col(out).asc_nulls_last(), F.col(key)).limit(k)


def within(df: DataFrame, query, radius: float, v: str = "embedding", metric: str = "l2", kind: Kind | None = None, out: str = "distance") -> DataFrame:
    """Rows nearer than the radius."""
    kind = kind or kind_of(df, v)[0]
    return df.withColumn(out, distance_to(v, query, metric, kind)).where(F.col(out) < radius)


def with_ties(df: DataFrame, query, k: int, v: str = "embedding", key: str = "vec_id", metric: str = "l2", kind: Kind | None = None, out: str = "distance") -> DataFrame:
    """Rows up to the distance of the k-th, ties included."""
    kind = kind or kind_of(df, v)[0]
    scored = df.withColumn(out, distance_to(v, query, metric, kind))
    most = scored.orderBy(F.col(out).asc_nulls_last()).limit(k).agg(F.max(out).alias("_most"))  # one row
    return scored.join(F.broadcast(most), F.col(out) <= F.col("_most")).drop("_most")


def arrow_types(*names: str) -> tuple[pa.DataType, ...]:
    """Arrow types of Spark types by name, for batches that Python workers return."""
    return tuple(to_arrow_type(_parse_datatype_string(n)) for n in names)


class TopK:
    """The k best (distance, key) of each query, as arrays; NaN comes after all numbers."""

    def __init__(self, k: int):
        self.k, self.query, self.distance, self.key = k, np.empty(0, np.int64), np.empty(0), None

    def add(self, query: np.ndarray, distance: np.ndarray, key: np.ndarray) -> None:
        self.query, self.distance = np.concatenate([self.query, query]), np.concatenate([self.distance, distance])
        self.key = key if self.key is None else np.concatenate([self.key, key])
        order = np.lexsort((self.key if self.key.dtype.kind in "iu" else np.unique(self.key, return_inverse=True)[1], self.distance, self.query))
        sorted_query = self.query[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        order = order[place < self.k]
        self.query, self.distance, self.key = self.query[order], self.distance[order], self.key[order]

    def worst(self, queries: int) -> np.ndarray:
        """The k-th distance of each query; infinite while there are fewer."""
        out = np.full(queries, np.inf)
        counts = np.bincount(self.query, minlength=queries)
        full = np.flatnonzero(counts == self.k)
        last = np.cumsum(counts) - 1
        out[full] = self.distance[last[full]]
        return np.where(np.isnan(out), np.inf, out)


class Best:
    """The k best of every query, in blocks of QUERIES, so that neither sorting nor a matrix of distances grows with the queries."""

    def __init__(self, k: int, queries: int):
        self.k, self.blocks = k, [TopK(k) for _ in range(0, queries, QUERIES)]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query, distance and key of each block that has rows."""
        return ((top.query + n * QUERIES, top.distance, top.key) for n, top in enumerate(self.blocks) if top.key is not None)


def candidates(near: np.ndarray, limit: np.ndarray, k: int, metric) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column of near) that may be among a row's k nearest, given the k-th so far; infinite ones take no part in that."""
    some = np.flatnonzero(np.isinf(limit))
    if near.shape[1] > k and len(some):
        limit = limit.copy()
        limit[some] = np.partition(near[some], k - 1, 1)[:, k - 1]
    with np.errstate(over="ignore"):
        slack = np.minimum(limit + 1e-6 * np.abs(limit) + 1e-5 * (metric.name in ("l2", "ip", "cosine")), np.finfo(np.float64).max)
    return np.nonzero(near <= slack[:, None])


def add_exact(queries, rows, q: np.ndarray, r: np.ndarray, metric, top: TopK, keyed, names: np.ndarray | None = None) -> None:
    """Adds pairs (query q, row r) to top, scored exactly.

    keyed: places of pairs -> the places again, once for each of the row's keys, and these keys. names: how top calls
    the queries.
    """
    width = len(rows.words[0]) if rows.form == "bit" and len(rows) else rows.values.shape[1] if rows.form == "dense" else 64
    step = max(1, PAIR_BYTES // (8 * max(1, width)))
    for a in range(0, len(q), step):
        some = np.arange(a, min(len(q), a + step))
        distance = metric.exact(queries.take(q[some]), rows.take(r[some]))
        place, keys = keyed(some)
        top.add(q[place] if names is None else names[q[place]], distance[place - a], keys)


def scored_candidates(queries, rows, keys: np.ndarray, metric, best: Best, which: np.ndarray | None = None) -> None:
    """Adds to best whatever of the rows may be among a query's k nearest, scored exactly. which: queries that ask, ascending; all without it."""
    which = np.arange(len(queries)) if which is None else which
    for n, top in enumerate(best.blocks):
        ids = which[np.searchsorted(which, n * QUERIES) : np.searchsorted(which, (n + 1) * QUERIES)]
        if not len(ids):
            continue
        block, own = queries.take(ids), ids - n * QUERIES
        for at in range(0, len(rows), ROWS):
            part, part_keys = rows.take(np.arange(at, min(len(rows), at + ROWS))), keys[at : at + ROWS]
            near = metric.near(block, part)
            near[~(near < np.inf)] = np.finfo(np.float64).max  # NaN comes after all numbers, but it does come
            q, r = candidates(near, top.worst(QUERIES)[own], best.k, metric)
            add_exact(block, part, q, r, metric, top, lambda some, part_keys=part_keys, r=r: (some, part_keys[r[some]]), own)


def query_blocks(queries: DataFrame, v: str, key: str, limit: int = QUERY_BYTES) -> Iterator[pa.Table]:
    """The queries without nulls, in tables of about `limit` bytes of vectors each."""
    live = queries.where(F.col(v).isNotNull()).select(F.col(key).alias("_q"), F.col(v).alias("_v"))
    kind = kind_of(queries, v)[0]
    width = F.size(F.col("_v.indices")) * 12 if kind is SPARSE else F.size(F.col("_v.words")) * 8 if kind is BIT else F.size("_v") * 4
    total = live.agg(F.sum(width + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) * 2 // limit)) if total > limit else 1
    for block in range(blocks):
        part = live if blocks == 1 else live.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block)
        yield part.toArrow()


def top_k(candidates: DataFrame, k: int, query: str, key: str, out: str) -> DataFrame:
    """Each query's k best of all tasks' candidates, with their rank."""
    order = Window.partitionBy(query).orderBy(F.col(out).asc_nulls_last(), F.col(key))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, df: DataFrame, k: int, v: str = "embedding", key: str = "vec_id", query_v: str | None = None, query_key: str | None = None, metric: str = "l2", kind: Kind | None = None, out: str = "distance", query: str = "query_id", limit: int = QUERY_BYTES) -> DataFrame:
    """query, key, distance and rank of the k rows of df nearest to each row of queries; null vectors take no part."""
    kind = kind or kind_of(df, v)[0]
    scorer = metric_of(metric, kind)
    query_v, query_key = query_v or v, query_key or key
    types = (queries.schema[query_key].dataType.simpleString(), df.schema[key].dataType.simpleString())
    schema = f"{query} {types[0]}, {key} {types[1]}, {out} double"
    rows = df.where(F.col(v).isNotNull()).select(F.col(key).alias("_k"), F.col(v).alias("_v"))
    found = None
    for block in query_blocks(queries, query_v, query_key, limit):
        shared = share(df.sparkSession, (block.column("_q").to_pylist(), batch_of(block.column("_v"), kind)))

        q_type, k_type = arrow_types(*types)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            best = Best(k, len(asked))
            for batch in batches:
                if len(asked) and batch.num_rows:
                    own = batch_of(batch.column("_v"), kind)
                    check_same(asked, own, kind)
                    scored_candidates(asked, own, np.array(batch.column("_k").to_pylist()), scorer, best)
            for asking, distance, ids in best:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in asking.tolist()], q_type), pa.array(ids.tolist(), k_type), pa.array(distance, pa.float64())], [query, key, out])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, query, key, out)


def rerank(candidates: DataFrame, query, k: int, v: str = "embedding", key: str = "vec_id", metric: str = "l2", out: str = "distance") -> DataFrame:
    """The k nearest of the candidates by the full distance."""
    return nearest(candidates, query, k, v, key, metric, out=out)


def quantized_search(df: DataFrame, query, k: int, over: int, v: str = "embedding", key: str = "vec_id", metric: str = "cosine", out: str = "distance") -> DataFrame:
    """over rows nearest by Hamming distance of the signs, then the k nearest of them in full."""
    bits = expr.hamming_distance(expr.binary_quantize(F.col(v)), expr.binary_quantize(expr.lit_vector(query)))
    rough = df.withColumn("_bits", bits).orderBy(F.col("_bits").asc_nulls_last(), F.col(key)).limit(over).drop("_bits")
    return rerank(rough, query, k, v, key, metric, out)


def subvector_search(df: DataFrame, query, k: int, over: int, start: int, count: int, v: str = "embedding", key: str = "vec_id", metric: str = "cosine", out: str = "distance") -> DataFrame:
    """over rows nearest by a part of the vectors, then the k nearest of them in full."""
    rough = df.withColumn("_part", metric_of(metric, VECTOR).column(expr.subvector(F.col(v), start, count), expr.lit_vector(query[start - 1 : start - 1 + count])))
    return rerank(rough.orderBy(F.col("_part").asc_nulls_last(), F.col(key)).limit(over).drop("_part"), query, k, v, key, metric, out)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, key: str = "vec_id", rank: str = "rank", constant: int = 60, out: str = "score") -> DataFrame:
    """Two rankings (key, rank) as one: the sum of 1 / (constant + rank)."""
    a, b = first.select(key, F.col(rank).alias("_a")), second.select(key, F.col(rank).alias("_b"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full").select(key, (part("_a") + part("_b")).alias(out))


def written(df: DataFrame) -> DataFrame:
    """df, worked out now and written to the session's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark))
    return df.checkpoint()


def placed(df: DataFrame, *order: Column, out: str = "place") -> DataFrame:
    """All rows in order, with the place of each from 1 on: a range-partitioned sort, then the counts of the parts before.

    The sorted rows are written once, so both passes see the same parts; one count a part comes to the driver.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()  # the part times 2^33, and the row within it
    rows = df.orderBy(*order).select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    rows = written(rows)
    offsets, before = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("_part").agg(F.count(F.lit(1))).collect())):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    return rows.join(starts, "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).cast("int").alias(out))


def recall_at_k(found: DataFrame, exact: DataFrame, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """One row: the part of the exact neighbours that were found."""
    hits = exact.select(query, key).join(found.select(query, key).distinct().withColumn("_hit", F.lit(1)), [query, key], "left")
    return hits.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
