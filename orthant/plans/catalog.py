"""Queries of the vector engine, one for each operator, and the DuckDB SQL that checks them.

Each takes (spark, sf_dir) and works on the whole `embeddings` table (with `documents`, `labels` where text or
attributes are needed). The query vector is that of vec_id 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import expr as E
from ..functions.kinds import BIT, HALF, SPARSE, VECTOR, with_kind
from ..operators import knn as K
from ..operators.hnsw import HnswIndex
from ..operators.ivf import IvfIndex
from ..sources import text as X
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str = "embeddings") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir).where("vec_id = 0").first()["embedding"]


def with_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings beside the one row of the query vector, q."""
    one = table(spark, sf_dir).where("vec_id = 0").select(F.col("embedding").alias("q"))
    return table(spark, sf_dir).crossJoin(F.broadcast(one))


# DuckDB twins

_Q = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_X, _Y = "CAST(x[1] AS DOUBLE)", "CAST(x[2] AS DOUBLE)"


def _sum(values: str) -> str:
    return f"list_reduce({values}, lambda s, t: s + t, CAST(0 AS DOUBLE))"


def _acc(a: str, b: str, f: str) -> str:
    return f"CAST(CAST({_sum(f'list_transform(list_zip({a}, {b}), lambda x: {f})')} AS FLOAT) AS DOUBLE)"


def _l2sq(a: str, b: str) -> str:
    return _acc(a, b, f"({_X} - {_Y}) * ({_X} - {_Y})")


def _ip(a: str, b: str) -> str:
    return _acc(a, b, f"{_X} * {_Y}")


def _cos(a: str, b: str) -> str:
    norms = f"({_ip(a, a)} * {_ip(b, b)})"
    return f"CASE WHEN {norms} = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1 - greatest(-1, least(1, {_ip(a, b)} / sqrt({norms}))) END"


_DUCK = {
    "l2": lambda a, b: f"sqrt({_l2sq(a, b)})",
    "l2_squared": _l2sq,
    "ip": _ip,
    "neg_ip": lambda a, b: f"-{_ip(a, b)}",
    "cosine": _cos,
    "l1": lambda a, b: _acc(a, b, f"abs({_X} - {_Y})"),
    "spherical": lambda a, b: f"acos(greatest(-1, least(1, {_ip(a, b)}))) / pi()",
}
_SPARK = {
    "l2": E.l2_distance, "l2_squared": E.l2_squared_distance, "ip": E.inner_product, "neg_ip": E.negative_inner_product, "cosine": E.cosine_distance,
    "l1": E.l1_distance, "spherical": E.spherical_distance,
}


def _half(x: str) -> str:
    step = f"pow(2, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14) - 10)"
    return f"CAST(CASE WHEN {x} = 0 THEN {x} ELSE round_even(CAST({x} AS DOUBLE) / {step}, 0) * {step} END AS FLOAT)"


_HALVES = f"list_transform(embedding, lambda x: {_half('x')})"
_THIN = "list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.1::FLOAT THEN 0::FLOAT ELSE x END)"
_SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


def _rows(values: str, source: str = "embeddings, q", of: str = "vec_id") -> str:
    """(vec_id, pos, val) of a list."""
    return f"WITH {_Q} SELECT {of}, unnest(range(1, len(v) + 1)) - 1 AS pos, unnest(v) AS val FROM (SELECT {of}, {values} AS v FROM {source})"


def exploded(df: DataFrame, value, *of: str) -> DataFrame:
    return df.select(*(of or ("vec_id",)), F.posexplode(value).alias("pos", "val")).withColumn("pos", F.col("pos").cast("long"))


def thin(c="embedding"):
    """The vector with its small elements zeroed."""
    return F.transform(c, lambda x: F.when(F.abs(x) < F.lit(0.1).cast("float"), F.lit(0.0).cast("float")).otherwise(x))


# Distances of dense, half, sparse and bit vectors


def _distance_queries() -> None:
    for name, f in _SPARK.items():
        duck = _DUCK[name]

        if name == "spherical":  # the last bit of an arc cosine is the platform's
            f, duck = (lambda a, b, kind=VECTOR: F.round(E.spherical_distance(a, b, kind), 12)), (lambda a, b, g=duck: f"round({g(a, b)}, 12)")

        @query(f"dist_{name}", f"WITH {_Q} SELECT vec_id, {duck('embedding', 'q')} AS distance FROM embeddings, q")
        def dense(spark, sf_dir, f=f):
            return with_first(spark, sf_dir).select("vec_id", f("embedding", "q").alias("distance"))

        @query(f"half_dist_{name}", f"WITH h AS (SELECT vec_id, {_HALVES} AS h FROM embeddings), q AS (SELECT h AS q FROM h WHERE vec_id = 0) SELECT vec_id, {duck('h', 'q')} AS distance FROM h, q")
        def half(spark, sf_dir, f=f):
            both = with_first(spark, sf_dir).select("vec_id", E.vector_to_halfvec("embedding").alias("h"), E.vector_to_halfvec("q").alias("q"))
            return both.select("vec_id", f("h", "q", HALF).alias("distance"))

        if name != "spherical":

            @query(f"sparse_dist_{name}", f"WITH h AS (SELECT vec_id, {_THIN} AS h FROM embeddings), q AS (SELECT h AS q FROM h WHERE vec_id = 0) SELECT vec_id, {duck('h', 'q')} AS distance FROM h, q")
            def sparse(spark, sf_dir, f=f):
                both = with_first(spark, sf_dir).select("vec_id", E.vector_to_sparsevec(thin("embedding")).alias("s"), E.vector_to_sparsevec(thin("q")).alias("q"))
                return both.select("vec_id", f("s", "q", SPARSE).alias("distance"))


_distance_queries()

_BIT_PAIRS = f"WITH b AS (SELECT vec_id, {_SIGNS} AS b FROM embeddings), q AS (SELECT b AS q FROM b WHERE vec_id = 0)"
_BOTH = "list_sum(list_transform(list_zip(b, q), lambda x: x[1] * x[2]))"
_HAM = "CAST(list_sum(list_transform(list_zip(b, q), lambda x: abs(x[1] - x[2]))) AS DOUBLE)"
_JAC = f"CASE WHEN {_BOTH} = 0 THEN 1 ELSE 1 - CAST({_BOTH} AS DOUBLE) / (list_sum(b) + list_sum(q) - {_BOTH}) END"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_first(spark, sf_dir).select("vec_id", E.binary_quantize("embedding").alias("b"), E.binary_quantize("q").alias("q"))


@query("bit_hamming", f"{_BIT_PAIRS} SELECT vec_id, {_HAM} AS distance FROM b, q")
def bit_hamming(spark, sf_dir):
    return _bits(spark, sf_dir).select("vec_id", E.hamming_distance("b", "q").alias("distance"))


@query("bit_jaccard", f"{_BIT_PAIRS} SELECT vec_id, CAST({_JAC} AS DOUBLE) AS distance FROM b, q")
def bit_jaccard(spark, sf_dir):
    return _bits(spark, sf_dir).select("vec_id", E.jaccard_distance("b", "q").alias("distance"))


@query("similarity", f"WITH {_Q} SELECT vec_id, 1 - {_cos('embedding', 'q')} AS cosine_similarity, {_ip('embedding', 'q')} AS ip FROM embeddings, q")
def similarity(spark, sf_dir):
    return with_first(spark, sf_dir).select("vec_id", E.cosine_similarity("embedding", "q").alias("cosine_similarity"), (E.negative_inner_product("embedding", "q") * -1).alias("ip"))


# Arithmetic, norms, slices, comparison


@query("vec_dims", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def vec_dims(spark, sf_dir):
    return table(spark, sf_dir).select("vec_id", E.vector_dims("embedding").alias("dims"))


_NORM = _sum("list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))")


@query("vec_norm", f"SELECT vec_id, sqrt({_NORM.format('embedding')}) AS norm FROM embeddings")
def vec_norm(spark, sf_dir):
    return table(spark, sf_dir).select("vec_id", E.vector_norm("embedding").alias("norm"))


@query("half_norm", f"SELECT vec_id, sqrt({_NORM.format('h')}) AS norm FROM (SELECT vec_id, {_HALVES} AS h FROM embeddings)")
def half_norm(spark, sf_dir):
    return table(spark, sf_dir).select("vec_id", E.vector_norm(E.vector_to_halfvec("embedding"), HALF).alias("norm"))


@query("sparse_norm", f"SELECT vec_id, sqrt({_NORM.format('h')}) AS norm FROM (SELECT vec_id, {_THIN} AS h FROM embeddings)")
def sparse_norm(spark, sf_dir):
    return table(spark, sf_dir).select("vec_id", E.vector_norm(E.vector_to_sparsevec(thin()), SPARSE).alias("norm"))


def _normalized(v: str) -> str:
    return f"list_transform({v}, lambda x: CAST(CAST(x AS DOUBLE) / n AS FLOAT))"


@query("vec_normalize", _rows(_normalized("embedding"), f"(SELECT *, sqrt({_NORM.format('embedding')}) AS n FROM embeddings)"))
def vec_normalize(spark, sf_dir):
    return exploded(table(spark, sf_dir), E.l2_normalize("embedding"))


@query("half_normalize", f"SELECT vec_id, unnest(range(1, 65)) - 1 AS pos, unnest(list_transform(v, lambda x: {_half('x')})) AS val FROM (SELECT vec_id, list_transform(h, lambda x: CAST(x AS DOUBLE) / n) AS v FROM (SELECT vec_id, h, sqrt({_NORM.format('h')}) AS n FROM (SELECT vec_id, {_HALVES} AS h FROM embeddings)))")
def half_normalize(spark, sf_dir):
    return exploded(table(spark, sf_dir).withColumn("h", E.vector_to_halfvec("embedding")), E.l2_normalize("h", HALF))


@query("sparse_normalize", _rows(_normalized("h"), f"(SELECT *, sqrt({_NORM.format('h')}) AS n FROM (SELECT vec_id, {_THIN} AS h FROM embeddings))"))
def sparse_normalize(spark, sf_dir):
    made = table(spark, sf_dir).select("vec_id", E.vector_to_sparsevec(thin()).alias("s")).select("vec_id", E.l2_normalize("s", SPARSE).alias("s"))
    return exploded(made, E.sparsevec_to_vector("s"))


def _arithmetic_queries() -> None:
    for name, f, sign in (("add", E.vector_add, "+"), ("sub", E.vector_sub, "-"), ("mul", E.vector_mul, "*")):

        @query(f"vec_{name}", _rows(f"list_transform(list_zip(embedding, q), lambda x: CAST({_X} {sign} {_Y} AS FLOAT))"))
        def dense(spark, sf_dir, f=f):
            return exploded(with_first(spark, sf_dir), f("embedding", "q"))

        if name != "mul":  # small elements' products are below half precision, which is an error

            @query(f"half_{name}", _rows(f"list_transform(list_transform(list_zip({_HALVES}, list_transform(q, lambda x: {_half('x')})), lambda x: {_X} {sign} {_Y}), lambda x: {_half('x')})"))
            def half(spark, sf_dir, f=f):
                both = with_first(spark, sf_dir).select("vec_id", E.vector_to_halfvec("embedding").alias("a"), E.vector_to_halfvec("q").alias("b"))
                return exploded(both, f("a", "b", HALF))


_arithmetic_queries()


@query("vec_concat", _rows("list_concat(embedding, q)"))
def vec_concat(spark, sf_dir):
    return exploded(with_first(spark, sf_dir), E.vector_concat("embedding", "q"))


@query("vec_subvector", _rows("embedding[9:24]"))
def vec_subvector(spark, sf_dir):
    return exploded(table(spark, sf_dir), E.subvector("embedding", 9, 16))


@query("vec_quantize", f"SELECT vec_id, array_to_string({_SIGNS}, '') AS bits FROM embeddings")
def vec_quantize(spark, sf_dir):
    return table(spark, sf_dir).select("vec_id", E.bit_to_text(E.binary_quantize("embedding")).alias("bits"))


@query("vec_cmp", f"WITH {_Q} SELECT vec_id, embedding < q AS lt, embedding <= q AS le, embedding = q AS eq, embedding <> q AS ne, embedding >= q AS ge, embedding > q AS gt, CASE WHEN embedding < q THEN -1 WHEN embedding > q THEN 1 ELSE 0 END AS cmp FROM embeddings, q")
def vec_cmp(spark, sf_dir):
    pair = ("embedding", "q")
    return with_first(spark, sf_dir).select("vec_id", *(f(*pair).alias(n) for n, f in (("lt", E.lt), ("le", E.le), ("eq", E.eq), ("ne", E.ne), ("ge", E.ge), ("gt", E.gt), ("cmp", E.compare))))


@query("sparse_cmp", f"WITH h AS (SELECT vec_id, {_THIN} AS h FROM embeddings), q AS (SELECT h AS q FROM h WHERE vec_id = 0) SELECT vec_id, h < q AS lt, h = q AS eq, CASE WHEN h < q THEN -1 WHEN h > q THEN 1 ELSE 0 END AS cmp FROM h, q")
def sparse_cmp(spark, sf_dir):
    both = with_first(spark, sf_dir).select("vec_id", E.vector_to_sparsevec(thin("embedding")).alias("a"), E.vector_to_sparsevec(thin("q")).alias("b"))
    return both.select("vec_id", E.lt("a", "b", SPARSE).alias("lt"), E.eq("a", "b", SPARSE).alias("eq"), E.compare("a", "b", SPARSE).alias("cmp"))


# Aggregates

_ELEMENTS = "SELECT label, unnest(range(1, len(embedding) + 1)) - 1 AS pos, CAST(unnest({0}) AS DOUBLE) AS x FROM embeddings"


def _aggregate_queries() -> None:
    for name, of_sum, source, kind in (("agg_avg", False, "embedding", VECTOR), ("agg_sum", True, "embedding", VECTOR), ("half_avg", False, _HALVES, HALF), ("half_sum", True, _HALVES, HALF)):
        value = "sum(x)" if of_sum else "avg(x)"
        value = _half(value) if kind is HALF else f"CAST({value} AS FLOAT)"

        @query(name, f"SELECT pos, {value} AS val FROM ({_ELEMENTS.format(source)}) GROUP BY pos")
        def whole(spark, sf_dir, of_sum=of_sum, kind=kind):
            df = table(spark, sf_dir).select(E.vector_to_halfvec("embedding").alias("v") if kind is HALF else F.col("embedding").alias("v"))
            done = agg.vector_sum(df, "v", kind=kind, out="v") if of_sum else agg.vector_avg(df, "v", kind=kind, out="v")
            return done.select(F.posexplode("v").alias("pos", "val")).withColumn("pos", F.col("pos").cast("long"))

    for name, of_sum in (("agg_avg_group", False), ("agg_sum_group", True)):

        @query(name, f"SELECT label, pos, CAST({'sum' if of_sum else 'avg'}(x) AS FLOAT) AS val FROM ({_ELEMENTS.format('embedding')}) GROUP BY label, pos")
        def grouped(spark, sf_dir, of_sum=of_sum):
            f = agg.vector_sum if of_sum else agg.vector_avg
            return exploded(f(table(spark, sf_dir), "embedding", ["label"], out="v"), "v", "label")


_aggregate_queries()

# Casts and forms


def _cast_queries() -> None:
    for name, duck, kind in (("int", "CAST(trunc(x * 100) AS INTEGER)", "int"), ("float", "x", "float"), ("double", "CAST(x AS DOUBLE) * 3", "double"), ("decimal", "CAST(trunc(x * 100) AS DECIMAL(10, 2))", "decimal(10,2)")):

        @query(f"cast_{name}_to_vector", _rows(f"list_transform(embedding, lambda x: CAST({duck} AS FLOAT))"))
        def dense(spark, sf_dir, kind=kind):
            hundred = F.lit(100).cast("float")  # by an integer, Spark would multiply in double precision, SQL in single
            scaled = {"int": lambda x: (x * hundred).cast("int"), "float": lambda x: x, "double": lambda x: x.cast("double") * 3, "decimal(10,2)": lambda x: (x * hundred).cast("int").cast("decimal(10,2)")}[kind]
            return exploded(table(spark, sf_dir), E.array_to_vector(F.transform("embedding", scaled), 64))


_cast_queries()


@query("cast_vector_to_halfvec", _rows(_HALVES))
def cast_vector_to_halfvec(spark, sf_dir):
    return exploded(table(spark, sf_dir), E.vector_to_halfvec("embedding", 64))


@query("cast_array_to_halfvec", _rows(f"list_transform(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 3 AS FLOAT)), lambda x: {_half('x')})"))
def cast_array_to_halfvec(spark, sf_dir):
    return exploded(table(spark, sf_dir), E.halfvec_to_vector(E.array_to_halfvec(F.transform("embedding", lambda x: x.cast("double") * 3))))


@query("cast_vector_to_sparsevec", f"SELECT vec_id, i AS idx, v[i] AS val FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, {_THIN} AS v FROM embeddings)) WHERE v[i] <> 0")
def cast_vector_to_sparsevec(spark, sf_dir):
    made = table(spark, sf_dir).select("vec_id", E.vector_to_sparsevec(thin(), 64).alias("s"))
    return made.select("vec_id", F.inline(F.arrays_zip("s.indices", "s.values"))).select("vec_id", F.col("indices").cast("long").alias("idx"), F.col("values").alias("val"))


@query("cast_sparse_round_trip", _rows(f"list_transform({_THIN}, lambda x: {_half('x')})"))
def cast_sparse_round_trip(spark, sf_dir):
    made = table(spark, sf_dir).select("vec_id", E.array_to_sparsevec(thin()).alias("s"))
    return exploded(made.select("vec_id", E.sparsevec_to_halfvec("s", 64).alias("h")), E.to_float_array("h"))


@query("text_round_trip", _rows("embedding"))
def text_round_trip(spark, sf_dir):
    made = table(spark, sf_dir).select("vec_id", X.to_text("embedding").alias("t")).select("vec_id", X.from_text("t", VECTOR, 64).alias("v"))
    return exploded(made, "v")


@query("sparse_text_round_trip", _rows(_THIN))
def sparse_text_round_trip(spark, sf_dir):
    made = table(spark, sf_dir).select("vec_id", E.vector_to_sparsevec(thin()).alias("s")).select("vec_id", X.to_text("s", SPARSE).alias("t"))
    return exploded(made.select("vec_id", X.from_text("t", SPARSE).alias("s")), E.sparsevec_to_vector("s"))


@query("binary_round_trip", _rows(_HALVES))
def binary_round_trip(spark, sf_dir):
    made = table(spark, sf_dir).select("vec_id", E.vector_to_halfvec("embedding").alias("h")).select("vec_id", X.to_binary("h", HALF).alias("b"))
    return exploded(made.select("vec_id", X.from_binary("b", HALF).alias("h")), "h")


@query("typed_column", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def typed_column(spark, sf_dir):
    return with_kind(table(spark, sf_dir), "embedding", "vector(64)").select("vec_id", E.vector_dims("embedding").alias("dims"))


# Exact search


def _knn(distance: str, k: int = 10, source: str = "embeddings, q", where: str = "") -> str:
    return f"WITH {_Q} SELECT vec_id, {distance} AS distance FROM {source} {where} ORDER BY distance, vec_id LIMIT {k}"


def _search_queries() -> None:
    for metric, duck in (("l2", _DUCK["l2"]), ("ip", _DUCK["neg_ip"]), ("cosine", _cos), ("l1", _DUCK["l1"])):

        @query(f"knn_{metric}", _knn(duck("embedding", "q")))
        def dense(spark, sf_dir, metric=metric):
            return K.nearest(table(spark, sf_dir), first_vector(spark, sf_dir), 10, metric=metric).select("vec_id", "distance")

        joined = f"SELECT query_id, vec_id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {duck('b.embedding', 'a.embedding')} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {duck('b.embedding', 'a.embedding')}, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE r <= 10"

        @query(f"knn_join_{metric}", joined)
        def many(spark, sf_dir, metric=metric):
            df = table(spark, sf_dir)
            return K.knn_join(df.where("vec_id % 20 = 0"), df, 10, metric=metric)

    for metric, duck in (("hamming", _HAM), ("jaccard", f"CAST({_JAC} AS DOUBLE)")):

        @query(f"knn_{metric}", f"{_BIT_PAIRS} SELECT vec_id, {duck} AS distance FROM b, q ORDER BY distance, vec_id LIMIT 10")
        def bits(spark, sf_dir, metric=metric):
            df = table(spark, sf_dir).withColumn("bits", E.binary_quantize("embedding"))
            signs = "".join("1" if x > 0 else "0" for x in first_vector(spark, sf_dir))
            return K.nearest(df, signs, 10, "bits", metric=metric, kind=BIT).select("vec_id", "distance")


_search_queries()


@query("knn_subquery", _knn(_DUCK["l2"]("embedding", "q")))
def knn_subquery(spark, sf_dir):
    """The query vector comes from a one-row subquery."""
    scored = with_first(spark, sf_dir).select("vec_id", E.l2_distance("embedding", "q").alias("distance"))
    return scored.orderBy(F.col("distance").asc_nulls_last(), "vec_id").limit(10)


@query("range_search", f"WITH {_Q} SELECT vec_id, {_DUCK['l2']('embedding', 'q')} AS distance FROM embeddings, q WHERE {_DUCK['l2']('embedding', 'q')} < 1.3")
def range_search(spark, sf_dir):
    return K.within(table(spark, sf_dir), first_vector(spark, sf_dir), 1.3).select("vec_id", "distance")


@query("knn_filtered", _knn(_DUCK["l2"]("embedding", "q"), where="WHERE label = 3 AND vec_id <> 0"))
def knn_filtered(spark, sf_dir):
    return K.nearest(table(spark, sf_dir).where("label = 3 AND vec_id <> 0"), first_vector(spark, sf_dir), 10).select("vec_id", "distance")


@query("knn_with_ties", f"WITH {_Q}, d AS (SELECT vec_id, {_HAM.replace('(b, q)', '(b, s)')} AS distance FROM (SELECT vec_id, {_SIGNS} AS b, list_transform(q, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings, q)) SELECT * FROM d WHERE distance <= (SELECT max(distance) FROM (SELECT distance FROM d ORDER BY distance LIMIT 10))")
def knn_with_ties(spark, sf_dir):
    df = table(spark, sf_dir).withColumn("bits", E.binary_quantize("embedding"))
    signs = "".join("1" if x > 0 else "0" for x in first_vector(spark, sf_dir))
    return K.with_ties(df, signs, 10, "bits", metric="hamming", kind=BIT).select("vec_id", "distance")


@query("knn_rerank_quantized", f"WITH {_Q}, c AS (SELECT vec_id, embedding, q FROM (SELECT vec_id, embedding, q, {_SIGNS} AS b, list_transform(q, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings, q) ORDER BY {_HAM.replace('(b, q)', '(b, s)')}, vec_id LIMIT 50) SELECT vec_id, {_cos('embedding', 'q')} AS distance FROM c ORDER BY distance, vec_id LIMIT 10")
def knn_rerank_quantized(spark, sf_dir):
    return K.quantized_search(table(spark, sf_dir), first_vector(spark, sf_dir), 10, 50).select("vec_id", "distance")


@query("knn_rerank_subvector", f"WITH {_Q}, c AS (SELECT vec_id, embedding, q FROM embeddings, q ORDER BY {_cos('embedding[1:16]', 'q[1:16]')}, vec_id LIMIT 50) SELECT vec_id, {_cos('embedding', 'q')} AS distance FROM c ORDER BY distance, vec_id LIMIT 10")
def knn_rerank_subvector(spark, sf_dir):
    return K.subvector_search(table(spark, sf_dir), first_vector(spark, sf_dir), 10, 50, 1, 16).select("vec_id", "distance")


@query("knn_rerank_half", f"WITH h AS (SELECT vec_id, embedding, {_HALVES} AS h FROM embeddings), q AS (SELECT embedding AS q, h AS qh FROM h WHERE vec_id = 0), c AS (SELECT vec_id, embedding, q FROM h, q ORDER BY {_DUCK['l2']('h', 'qh')}, vec_id LIMIT 50) SELECT vec_id, {_DUCK['l2']('embedding', 'q')} AS distance FROM c ORDER BY distance, vec_id LIMIT 10")
def knn_rerank_half(spark, sf_dir):
    rough = with_first(spark, sf_dir).withColumn("_h", E.l2_distance(E.vector_to_halfvec("embedding"), E.vector_to_halfvec("q"), HALF)).orderBy(F.col("_h").asc_nulls_last(), "vec_id").limit(50)
    return K.rerank(rough.drop("_h", "q"), first_vector(spark, sf_dir), 10).select("vec_id", "distance")


@query("knn_join_attr", f"WITH {_Q} SELECT e.vec_id, d.lang, {_DUCK['l2']('embedding', 'q')} AS distance FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, q WHERE d.lang = 'en' ORDER BY distance, e.vec_id LIMIT 10")
def knn_join_attr(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "lang")
    return K.nearest(table(spark, sf_dir).join(docs, "vec_id"), first_vector(spark, sf_dir), 10).select("vec_id", "lang", "distance")


@query("count_ordered", "SELECT count(*) AS n FROM (SELECT vec_id FROM embeddings ORDER BY embedding)")
def count_ordered(spark, sf_dir):
    """The whole ordered subquery is counted."""
    return table(spark, sf_dir).orderBy(E.order_by("embedding")).agg(F.count(F.lit(1)).alias("n"))


_WORD = "the"


@query(
    "hybrid_rrf",
    f"""WITH {_Q}, t AS (SELECT doc_id, len(string_split(' ' || lower(text) || ' ', ' {_WORD} ')) - 1 AS n FROM documents),
    a AS (SELECT doc_id AS vec_id, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM t WHERE n > 0 ORDER BY r LIMIT 50),
    b AS (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS r FROM (SELECT vec_id, {_DUCK['l2']('embedding', 'q')} AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 50))
    SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, coalesce(1.0::DOUBLE / (60.0::DOUBLE + a.r), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + b.r), 0) AS score FROM a FULL JOIN b ON a.vec_id = b.vec_id""",
)
def hybrid_rrf(spark, sf_dir):
    count = F.size(F.split(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), f" {_WORD} ")) - 1
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), count.alias("n")).where("n > 0").orderBy(F.col("n").desc(), "vec_id").limit(50)
    near = K.nearest(table(spark, sf_dir), first_vector(spark, sf_dir), 50)
    # fifty rows each, so one window over all is small
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return K.reciprocal_rank_fusion(ranked(words, F.col("n").desc(), F.col("vec_id")), ranked(near, F.col("distance"), F.col("vec_id")))


# Ordering, grouping, changes


@query("btree_order", "SELECT vec_id, CAST(row_number() OVER (ORDER BY embedding, vec_id) AS INTEGER) AS place FROM embeddings ORDER BY place")
def btree_order(spark, sf_dir):
    """The place of every row."""
    return K.placed(table(spark, sf_dir).select("vec_id", "embedding"), E.order_by("embedding"), F.col("vec_id")).select("vec_id", "place")


@query("btree_eq", f"WITH {_Q} SELECT vec_id FROM embeddings, q WHERE embedding = q")
def btree_eq(spark, sf_dir):
    return with_first(spark, sf_dir).where(E.eq("embedding", "q")).select("vec_id")


@query("group_by_vector", "SELECT array_to_string(b, '') AS bits, count(*) AS n FROM (SELECT list_transform(embedding[1:4], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings) GROUP BY b")
def group_by_vector(spark, sf_dir):
    grouped = table(spark, sf_dir).groupBy(E.binary_quantize(E.subvector("embedding", 1, 4)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(E.bit_to_text("b").alias("bits"), "n")


@query("distinct_vector", "SELECT count(DISTINCT embedding) AS n FROM embeddings")
def distinct_vector(spark, sf_dir):
    return table(spark, sf_dir).agg(F.count_distinct("embedding").alias("n"))


@query("set_operations", "SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 EXCEPT SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0")
def set_operations(spark, sf_dir):
    df = table(spark, sf_dir).select("vec_id", "embedding")
    return df.where("vec_id % 2 = 0").intersect(df.where("vec_id % 3 = 0")).subtract(df.where("vec_id % 5 = 0")).select("vec_id")


@query("upsert", _rows("v", "(SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, coalesce(b.e, a.embedding) AS v FROM embeddings a FULL JOIN (SELECT vec_id + 5 AS vec_id, embedding AS e FROM embeddings WHERE vec_id % 7 = 0) b ON a.vec_id = b.vec_id)"))
def upsert(spark, sf_dir):
    df = table(spark, sf_dir).select("vec_id", "embedding")
    new = df.where("vec_id % 7 = 0").select((F.col("vec_id") + 5).alias("vec_id"), F.col("embedding").alias("e"))
    return exploded(df.join(new, "vec_id", "full").select("vec_id", F.coalesce("e", "embedding").alias("v")), "v")


@query("array_agg_vector", "SELECT label, unnest(range(1, len(v) + 1)) - 1 AS pos, CAST(unnest(v) AS FLOAT) AS val FROM (SELECT label, list(vec_id ORDER BY vec_id) AS v FROM embeddings GROUP BY label)")
def array_agg_vector(spark, sf_dir):
    made = table(spark, sf_dir).groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return exploded(made, E.array_to_vector("ids"), "label")


@query("sql_operators", f"WITH {_Q} SELECT vec_id, {_DUCK['l2']('embedding', 'q')} AS l2, {_DUCK['neg_ip']('embedding', 'q')} AS ip, {_cos('embedding', 'q')} AS cosine, {_DUCK['l1']('embedding', 'q')} AS l1 FROM embeddings, q WHERE label <> 1 ORDER BY l2, vec_id LIMIT 20")
def sql_operators(spark, sf_dir):
    """The operators as SQL, rewritten for Spark's parser."""
    text = "SELECT vec_id, embedding <-> q AS l2, embedding <#> q AS ip, embedding <=> q AS cosine, embedding <+> q AS l1 FROM orthant_pairs WHERE label <> 1 ORDER BY embedding <-> q, vec_id LIMIT 20"
    return S.sql(spark, text, orthant_pairs=with_first(spark, sf_dir))


def _sql_queries() -> None:
    """The statements users write, over embeddings (orthant_pairs: with q beside each row)."""
    difference = f"list_transform(list_zip(list_transform(list_zip(embedding, q), lambda x: CAST({_X} + {_Y} AS FLOAT)), list_transform(list_zip(embedding, q), lambda x: CAST({_X} * {_Y} AS FLOAT))), lambda x: CAST({_X} - {_Y} AS FLOAT))"
    for name, text, duck, of in (
        ("arithmetic", "SELECT vec_id, embedding + q - embedding * q AS v FROM orthant_pairs", _rows(difference), "vec_id"),
        ("normalize", "SELECT vec_id, l2_normalize(embedding) AS v FROM orthant_pairs", ORACLES["vec_normalize"], "vec_id"),
        ("subvector", "SELECT vec_id, subvector(embedding, 9, 16)::vector(16) AS v FROM orthant_pairs", ORACLES["vec_subvector"], "vec_id"),
        ("cast_half", "SELECT vec_id, embedding::halfvec(64) AS v FROM orthant_pairs", ORACLES["cast_vector_to_halfvec"], "vec_id"),
        ("avg", "SELECT label, avg(embedding) AS v FROM orthant_pairs GROUP BY label", ORACLES["agg_avg_group"], "label"),
        ("sum", "SELECT label, sum(embedding) AS v FROM orthant_pairs GROUP BY label", ORACLES["agg_sum_group"], "label"),
    ):

        @query(f"sql_{name}", duck)
        def listed(spark, sf_dir, text=text, of=of):
            return exploded(S.sql(spark, text, orthant_pairs=with_first(spark, sf_dir)), "v", of)


_sql_queries()


@query("sql_functions", f"WITH {_Q} SELECT vec_id, sqrt({_NORM.format('embedding')}) AS norm, CAST(len(embedding) AS INTEGER) AS dims, {_HAM.replace('(b, q)', f'({_SIGNS}, ' + _SIGNS.replace('embedding', 'q') + ')')} AS apart, {_DUCK['l1']('embedding[1:8]', 'q[1:8]')} AS near FROM embeddings, q")
def sql_functions(spark, sf_dir):
    text = "SELECT vec_id, l2_norm(embedding) AS norm, vector_dims(embedding) AS dims, binary_quantize(embedding) <~> binary_quantize(q) AS apart, subvector(embedding, 1, 8) <+> subvector(q, 1, 8) AS near FROM orthant_pairs"
    return S.sql(spark, text, orthant_pairs=with_first(spark, sf_dir))


@query("sql_sparse", f"WITH h AS (SELECT vec_id, {_THIN} AS h FROM embeddings), q AS (SELECT h AS q FROM h WHERE vec_id = 0) SELECT vec_id, {_DUCK['l2']('h', 'q')} AS l2, {_DUCK['neg_ip']('h', 'q')} AS ip, {_cos('h', 'q')} AS cosine, {_DUCK['l1']('h', 'q')} AS l1, sqrt({_NORM.format('h')}) AS norm FROM h, q")
def sql_sparse(spark, sf_dir):
    """Distances of sparse vectors as SQL; both are cast from dense ones."""
    both = with_first(spark, sf_dir).select("vec_id", thin("embedding").alias("h"), thin("q").alias("q"))
    text = "SELECT vec_id, h::sparsevec <-> q::sparsevec AS l2, h::sparsevec <#> q::sparsevec AS ip, h::sparsevec <=> q::sparsevec AS cosine, h::sparsevec <+> q::sparsevec AS l1, l2_norm(h::sparsevec) AS norm FROM orthant_thin"
    return S.sql(spark, text, orthant_thin=both)


# Indexes; their folders lie in the session's shared folder


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).where("vec_id % 20 = 0")


@query("ivf_full_probe", ORACLES["knn_join_l2"])
def ivf_full_probe(spark, sf_dir):
    """All lists probed: equal to exact search."""
    return IvfIndex.build(table(spark, sf_dir), lists=20).search(_asked(spark, sf_dir), 10, probes=20)


@query("ivf_bit_full_probe", f"SELECT query_id, vec_id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM (SELECT a.vec_id AS query_id, e.vec_id, {_HAM.replace('(b, q)', '(e.b, a.b)')} AS distance FROM (SELECT vec_id, {_SIGNS} AS b FROM embeddings WHERE vec_id % 20 = 0) a, (SELECT vec_id, {_SIGNS} AS b FROM embeddings) e)) WHERE r <= 10")
def ivf_bit_full_probe(spark, sf_dir):
    bits = table(spark, sf_dir).select("vec_id", E.binary_quantize("embedding").alias("bits"))
    return IvfIndex.build(bits, "bits", metric="hamming", lists=10).search(bits.where("vec_id % 20 = 0"), 10, probes=10, v="bits")


@query("ivf_probe")
def ivf_probe(spark, sf_dir):
    """14 of 20 lists: the least recall measured on the given tables is over 0.9."""
    return IvfIndex.build(table(spark, sf_dir), lists=20, metric="cosine").search(_asked(spark, sf_dir), 10, probes=14)


@query("ivf_iterative")
def ivf_iterative(spark, sf_dir):
    """Starts with 16 of 20 lists, for a recall of over 0.9: it stops where ten rows pass the filter, not where they are the nearest."""
    index = IvfIndex.build(table(spark, sf_dir), lists=20)
    return index.search(_asked(spark, sf_dir), 10, probes=16, iterative="relaxed_order", allowed=table(spark, sf_dir).where("label = 3"), mode="post")


@query("ivf_prefiltered", "SELECT query_id, vec_id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, " + _DUCK["l2"]("b.embedding", "a.embedding") + " AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY " + _DUCK["l2"]("b.embedding", "a.embedding") + ", b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label = 3) WHERE r <= 10")
def ivf_prefiltered(spark, sf_dir):
    index = IvfIndex.build(table(spark, sf_dir), lists=20)
    return index.search(_asked(spark, sf_dir), 10, probes=20, allowed=table(spark, sf_dir).where("label = 3"))


@query("ivf_list_sizes", "SELECT count(*) AS n_rows FROM embeddings")
def ivf_list_sizes(spark, sf_dir):
    return IvfIndex.build(table(spark, sf_dir), lists=20).stats().agg(F.sum("n_rows").alias("n_rows"))


_MAINTAINED = "SELECT vec_id AS key FROM embeddings WHERE vec_id < 50 OR vec_id >= 100"


def _maintain(df, index):
    """Inserts, deletes, inserts some of the deleted keys again, and compacts."""
    index.insert(df.where("vec_id < 50"))
    index.delete(df.where("vec_id < 100"))
    index.insert(df.where("vec_id < 50"))
    index.compact()
    return index


@query("ivf_maintained", _MAINTAINED)
def ivf_maintained(spark, sf_dir):
    df = table(spark, sf_dir)
    return _maintain(df, IvfIndex.build(df.where("vec_id >= 50"), lists=10)).entries().select("key")


@query("hnsw_maintained", _MAINTAINED)
def hnsw_maintained(spark, sf_dir):
    df = table(spark, sf_dir)
    return _maintain(df, HnswIndex.build(df.where("vec_id >= 50"))).rows().select("key")


@query("hnsw_search")
def hnsw_search(spark, sf_dir):
    return HnswIndex.build(table(spark, sf_dir)).search(_asked(spark, sf_dir), 10)


@query("hnsw_full", ORACLES["knn_join_cosine"])
def hnsw_full(spark, sf_dir):
    """A beam as wide as a shard: equal to exact search."""
    return HnswIndex.build(table(spark, sf_dir), metric="cosine", shard_rows=500).search(_asked(spark, sf_dir), 10, ef_search=1000)


@query("hnsw_iterative")
def hnsw_iterative(spark, sf_dir):
    index = HnswIndex.build(table(spark, sf_dir))
    return index.search(_asked(spark, sf_dir), 10, iterative="strict_order", allowed=table(spark, sf_dir).where("label = 3"))


@query("hnsw_sparse")
def hnsw_sparse(spark, sf_dir):
    sparse = table(spark, sf_dir).select("vec_id", E.vector_to_sparsevec(thin()).alias("s"))
    return HnswIndex.build(sparse, "s", metric="l2").search(sparse.where("vec_id % 20 = 0"), 10, v="s")


@query("hnsw_bits")
def hnsw_bits(spark, sf_dir):
    bits = table(spark, sf_dir).select("vec_id", E.binary_quantize("embedding").alias("bits"))
    return HnswIndex.build(bits, "bits", metric="jaccard").search(bits.where("vec_id % 20 = 0"), 10, v="bits")


def _halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and a typed half-precision column."""
    return with_kind(table(spark, sf_dir).select("vec_id", E.vector_to_halfvec("embedding").alias("embedding")), "embedding", "halfvec(64)")


_HALF_JOIN = f"WITH h AS (SELECT vec_id, {_HALVES} AS h FROM embeddings) SELECT query_id, vec_id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_DUCK['l2']('b.h', 'a.h')} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DUCK['l2']('b.h', 'a.h')}, b.vec_id) AS r FROM h a, h b WHERE a.vec_id % 20 = 0) WHERE r <= 10"


@query("half_knn_join", _HALF_JOIN)
def half_knn_join(spark, sf_dir):
    halves = _halved(spark, sf_dir)
    return K.knn_join(halves.where("vec_id % 20 = 0"), halves, 10)


@query("ivf_half_full_probe", _HALF_JOIN)
def ivf_half_full_probe(spark, sf_dir):
    halves = _halved(spark, sf_dir)
    return IvfIndex.build(halves, lists=10).search(halves.where("vec_id % 20 = 0"), 10, probes=10)


@query("hnsw_half")
def hnsw_half(spark, sf_dir):
    halves = _halved(spark, sf_dir)
    return HnswIndex.build(halves, metric="l1").search(halves.where("vec_id % 20 = 0"), 10)


@query("avg_states", f"SELECT label, pos, CAST(avg(x) AS FLOAT) AS val FROM ({_ELEMENTS.format('embedding')}) GROUP BY label, pos")
def avg_states(spark, sf_dir):
    """Averages from the partial states that workers would pass on: [count, sums...]."""
    states = table(spark, sf_dir).select("label", agg.accumulate_state("embedding").alias("s"))
    summed = states.groupBy("label").agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(65))).alias("s"))
    return exploded(summed, agg.final_avg("s"), "label")


@query("recall")
def recall(spark, sf_dir):
    """The part of the exact neighbours that an index finds, by probes."""
    df, asked = table(spark, sf_dir), _asked(spark, sf_dir)
    exact, index = K.knn_join(asked, df, 10), IvfIndex.build(df, lists=20)
    found = [K.recall_at_k(index.search(asked, 10, probes=p), exact).select(F.lit(p).alias("probes"), "recall") for p in (1, 5, 20)]
    return found[0].unionByName(found[1]).unionByName(found[2])
