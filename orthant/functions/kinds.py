"""Kinds of vector columns: their Spark types, limits, modifiers and error texts.

dense `vector` and `halfvec`: array<float> (half values are rounded to half precision already);
`sparsevec`: struct<dim int, indices array<int>, values array<float>>, indices from 1, ascending, no zeros;
`bit`: struct<nbits int, words array<bigint>>, the first bit highest, the last word filled with zeros.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    sql: str
    max_dim: int
    #: most dimensions (or non-zero values) that an index takes, by index method; absent: no such index
    index_limits: dict[str, int]

    def __hash__(self) -> int:
        return hash(self.name)


VECTOR = Kind("vector", "array<float>", 16000, {"ivf": 2000, "hnsw": 2000})
HALF = Kind("halfvec", "array<float>", 16000, {"ivf": 4000, "hnsw": 4000})
SPARSE = Kind("sparsevec", "struct<dim:int,indices:array<int>,values:array<float>>", 1_000_000_000, {"hnsw": 1000})
BIT = Kind("bit", "struct<nbits:int,words:array<bigint>>", 64000, {"ivf": 64000, "hnsw": 64000})
KINDS = {k.name: k for k in (VECTOR, HALF, SPARSE, BIT)}
MAX_NONZERO = 16000
HALF_MAX = 65504.0


class VectorError(ValueError):
    """A value or an option that the reference semantics reject."""


def parse_type(text: str) -> tuple[Kind, int | None]:
    """'vector(3)' -> (VECTOR, 3); the modifier is optional."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.S)
    if not m or m[1].lower() not in KINDS:
        raise VectorError(f'type "{text}" does not exist')
    kind = KINDS[m[1].lower()]
    if m[2] is None:
        return kind, None
    parts = [p.strip().strip("'") for p in m[2].split(",")]
    for p in parts:
        if not re.fullmatch(r"[+-]?\d+", p):
            raise VectorError(f'invalid input syntax for type integer: "{p}"')
    if len(parts) != 1:
        raise VectorError("invalid type modifier")
    dim = int(parts[0])
    if dim < 1:
        raise VectorError(f"dimensions for type {kind.name} must be at least 1")
    if dim > kind.max_dim:
        raise VectorError(f"dimensions for type {kind.name} cannot exceed {kind.max_dim}")
    return kind, dim


def with_kind(df: DataFrame, column: str, type_text: str) -> DataFrame:
    """df whose column carries its kind and length as metadata, rows of another length raising an error."""
    kind, dim = parse_type(type_text)
    value = F.col(column) if dim is None else assert_dims(F.col(column), dim, kind)
    return df.withMetadata(column, {"vector.kind": kind.name, "vector.dim": dim or 0}) if dim is None else df.withColumn(column, value).withMetadata(column, {"vector.kind": kind.name, "vector.dim": dim})


def kind_of(df: DataFrame, column: str) -> tuple[Kind, int | None]:
    """A column's kind and length: from its metadata, or else its type."""
    field = df.schema[column]
    if "vector.kind" in field.metadata:
        return KINDS[field.metadata["vector.kind"]], field.metadata.get("vector.dim") or None
    text = field.dataType.simpleString()
    for kind in (VECTOR, SPARSE, BIT):
        if text == kind.sql:
            return kind, None
    raise VectorError(f"column {column} of type {text} is no vector column")


def fail(*parts: Column | str, as_type: str) -> Column:
    """An expression that raises an error of these texts and values."""
    return F.raise_error(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))).cast(as_type)


def dims(v: Column, kind: Kind = VECTOR) -> Column:
    return v["dim"] if kind is SPARSE else v["nbits"] if kind is BIT else F.size(v)


def assert_dims(v: Column, n: int, kind: Kind = VECTOR) -> Column:
    """v, or an error if its length isn't n."""
    return F.when(dims(v, kind) != n, fail(f"expected {n} dimensions, not ", dims(v, kind), as_type=kind.sql)).otherwise(v)


def checked_dims(v: Column, kind: Kind) -> Column:
    """v, or an error if it has no or too many dimensions."""
    n = dims(v, kind)
    return (
        F.when(n < 1, fail(f"{kind.name} must have at least 1 dimension", as_type=kind.sql))
        .when(n > kind.max_dim, fail(f"{kind.name} cannot have more than {kind.max_dim} dimensions", as_type=kind.sql))
        .otherwise(v)
    )
