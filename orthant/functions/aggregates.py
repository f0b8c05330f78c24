"""avg and sum of vectors, as partial aggregates that Catalyst merges.

Elements are summed in double precision and rounded once, to single or half precision, so the result depends on no
order of rows. Null vectors are skipped; a group without any gives null. All vectors of a group need one length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import _finished, column
from .kinds import HALF, VECTOR, Kind, fail, kind_of

#: Up to this length every element has an aggregate of its own, in generated code; longer vectors are exploded.
UNROLLED = 256


def _checked(shortest: Column, longest: Column, dim: Column, of_sum: bool, kind: Kind, value: Column) -> Column:
    other = F.when(shortest != dim, shortest).otherwise(longest)
    error = fail(f"different {kind.name} dimensions ", dim, " and ", other, as_type=kind.sql) if of_sum else fail("expected ", dim, " dimensions, not ", other, as_type=kind.sql)
    return F.when((shortest != dim) | (longest != dim), error).otherwise(value)


def _element(total: Column, count: Column, of_sum: bool) -> Column:
    return total if of_sum else total / count


def fixed(v, dim: int, of_sum: bool = False, kind: Kind = VECTOR) -> Column:
    """An aggregate expression for vectors of a known length, for use in agg()."""
    v = column(v)
    count = F.count(v)
    values = F.array(*(_element(F.sum(F.get(v, F.lit(i)).cast("double")), count, of_sum) for i in range(dim)))
    return F.when(count > 0, _checked(F.min(F.size(v)), F.max(F.size(v)), F.lit(dim), of_sum, kind, _finished(values, kind)))


def _exploded(df: DataFrame, by: list[str], v: str, of_sum: bool, kind: Kind, out: str) -> DataFrame:
    sizes = df.groupBy(*by).agg(F.min(F.size(v)).alias("_short"), F.max(F.size(v)).alias("_long"), F.count(v).alias("_n"))
    parts = df.select(*by, F.posexplode(v).alias("_at", "_x")).groupBy(*by, "_at").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    arrays = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda e: e["_s"]).alias("_sums"))
    if by:
        matched = [sizes[c].eqNullSafe(arrays[c]) for c in by]
        on = matched[0]
        for m in matched[1:]:
            on = on & m
        joined = sizes.join(arrays, on, "left").select(*(sizes[c] for c in by), "_short", "_long", "_n", "_sums")
    else:
        joined = sizes.withColumn("_one", F.lit(1)).join(arrays.withColumn("_one", F.lit(1)), "_one", "left")
    values = F.transform("_sums", lambda s: _element(s, F.col("_n"), of_sum))
    return joined.select(*by, F.when(F.col("_n") > 0, _checked(F.col("_short"), F.col("_long"), F.col("_long"), of_sum, kind, _finished(values, kind))).alias(out))


def _grouped(df: DataFrame, v: str, by: list[str] | None, of_sum: bool, kind: Kind | None, dim: int | None, out: str) -> DataFrame:
    by = list(by or [])
    found, known = kind_of(df, v)
    kind, dim = kind or found, dim or known
    if dim is None:
        first = df.where(F.col(v).isNotNull()).select(F.size(v)).first()
        dim = first[0] if first else 1
    if dim > kind.max_dim:
        raise ValueError(f"{kind.name} cannot have more than {kind.max_dim} dimensions")
    return df.groupBy(*by).agg(fixed(v, dim, of_sum, kind).alias(out)) if dim <= UNROLLED else _exploded(df, by, v, of_sum, kind, out)


def vector_avg(df: DataFrame, v: str, by: list[str] | None = None, kind: Kind | None = None, dim: int | None = None, out: str = "avg") -> DataFrame:
    """by and the mean vector of each group."""
    return _grouped(df, v, by, False, kind, dim, out)


def vector_sum(df: DataFrame, v: str, by: list[str] | None = None, kind: Kind | None = None, dim: int | None = None, out: str = "sum") -> DataFrame:
    """by and the sum vector of each group."""
    return _grouped(df, v, by, True, kind, dim, out)


def halfvec_avg(df: DataFrame, v: str, by: list[str] | None = None, dim: int | None = None, out: str = "avg") -> DataFrame:
    return _grouped(df, v, by, False, HALF, dim, out)


def halfvec_sum(df: DataFrame, v: str, by: list[str] | None = None, dim: int | None = None, out: str = "sum") -> DataFrame:
    return _grouped(df, v, by, True, HALF, dim, out)


# The states that partial averages pass on: [count, sums...]


def accumulate_state(v) -> Column:
    """The state of one vector."""
    v = column(v)
    return F.concat(F.array(F.lit(1.0)), v.cast("array<double>"))


def combine_states(a, b) -> Column:
    a, b = column(a), column(b)
    differ = (F.size(a) != F.size(b)) & (F.size(a) > 1) & (F.size(b) > 1)
    error = fail("expected ", F.size(a) - 1, " dimensions, not ", F.size(b) - 1, as_type="array<double>")
    summed = F.zip_with(a, b, lambda x, y: x + y)
    return F.when(differ, error).when(F.size(a) <= 1, b).when(F.size(b) <= 1, a).otherwise(summed)


def final_avg(state, kind: Kind = VECTOR) -> Column:
    state = column(state)
    n = F.get(state, F.lit(0))
    too_long = fail(f"{kind.name} cannot have more than {kind.max_dim} dimensions", as_type=kind.sql)
    mean = _finished(F.transform(F.slice(state, 2, F.greatest(F.size(state) - 1, F.lit(1))), lambda x: x / n), kind)
    return F.when(n > 0, F.when(F.size(state) - 1 > kind.max_dim, too_long).otherwise(mean))
