"""Vector functions and operators as Column expressions; nothing leaves the JVM.

Distances sum in double precision from the first element on and are rounded once to single precision (so a
sum beyond its range is Infinity), then widened. Nulls give nulls. Lengths must agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import BIT, HALF, HALF_MAX, MAX_NONZERO, SPARSE, VECTOR, Kind, checked_dims, dims, fail

NAN = float("nan")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_vector(values) -> Column:
    """A dense literal; Catalyst folds it."""
    return F.array(*(F.lit(float(x)) for x in values)).cast("array<float>")


def same_dims(a: Column, b: Column, kind: Kind, value: Column, as_type: str) -> Column:
    what = "bit lengths" if kind is BIT else f"{kind.name} dimensions"
    return F.when(dims(a, kind) != dims(b, kind), fail(f"different {what} ", dims(a, kind), " and ", dims(b, kind), as_type=as_type)).otherwise(value)


def half_round(x: Column) -> Column:
    """The nearest half-precision value (ties to even) of a finite number, as double; beyond the range it is 65536 or more."""
    x = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when(x == 0, x).otherwise(F.rint(x / step) * step)


def _folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, t: s + t)


def _merge(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over the indices that either sparse vector has, ascending."""
    zero = F.lit(0.0)
    left = F.zip_with(a["indices"], a["values"], lambda i, x: F.struct(i.alias("i"), x.cast("double").alias("x"), zero.alias("y")))
    right = F.zip_with(b["indices"], b["values"], lambda i, y: F.struct(i.alias("i"), zero.alias("x"), y.cast("double").alias("y")))
    start = F.struct(F.lit(0).alias("i"), zero.alias("x"), zero.alias("y"), zero.alias("s"))

    def step(s: Column, e: Column) -> Column:
        again = s["i"] == e["i"]
        return F.struct(
            e["i"].alias("i"),
            F.when(again, s["x"] + e["x"]).otherwise(e["x"]).alias("x"),
            F.when(again, s["y"] + e["y"]).otherwise(e["y"]).alias("y"),
            F.when(again, s["s"]).otherwise(s["s"] + f(s["x"], s["y"])).alias("s"),
        )

    return F.aggregate(F.sort_array(F.concat(left, right)), start, step, lambda s: s["s"] + f(s["x"], s["y"]))


def accumulated(a: Column, b: Column, kind: Kind, f: Callable[[Column, Column], Column]) -> Column:
    if kind is SPARSE:
        total = _merge(a, b, f)
    else:
        total = _folded(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    return total.cast("float").cast("double")


def l2_squared_distance(a, b, kind: Kind = VECTOR) -> Column:
    a, b = column(a), column(b)
    return same_dims(a, b, kind, accumulated(a, b, kind, lambda x, y: (x - y) * (x - y)), "double")


def l2_distance(a, b, kind: Kind = VECTOR) -> Column:
    return F.sqrt(l2_squared_distance(a, b, kind))


def inner_product(a, b, kind: Kind = VECTOR) -> Column:
    a, b = column(a), column(b)
    return same_dims(a, b, kind, accumulated(a, b, kind, lambda x, y: x * y), "double")


def negative_inner_product(a, b, kind: Kind = VECTOR) -> Column:
    return -inner_product(a, b, kind)


def l1_distance(a, b, kind: Kind = VECTOR) -> Column:
    a, b = column(a), column(b)
    return same_dims(a, b, kind, accumulated(a, b, kind, lambda x, y: F.abs(x - y)), "double")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def cosine_distance(a, b, kind: Kind = VECTOR) -> Column:
    a, b = column(a), column(b)
    square = lambda v: _folded(F.transform(v["values"] if kind is SPARSE else v, lambda x: x.cast("double") * x.cast("double"))).cast("float").cast("double")
    parts = F.struct(accumulated(a, b, kind, lambda x, y: x * y).alias("dot"), (square(a) * square(b)).alias("norms"))

    def finish(p: Column) -> Column:
        ratio = p["dot"] / F.sqrt(p["norms"])
        return F.when((p["norms"] == 0) | F.isnan(p["norms"]), F.lit(NAN)).otherwise(F.when(F.isnan(ratio), F.lit(NAN)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))))

    return same_dims(a, b, kind, F.when(a.isNotNull() & b.isNotNull(), _bound(parts, finish)), "double")


def cosine_similarity(a, b, kind: Kind = VECTOR) -> Column:
    return 1 - cosine_distance(a, b, kind)


def spherical_distance(a, b, kind: Kind = VECTOR) -> Column:
    """Angle between unit vectors as a part of a half turn."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b, kind)))) / F.pi()


def vector_dims(v, kind: Kind = VECTOR) -> Column:
    return dims(column(v), kind)


def vector_norm(v, kind: Kind = VECTOR) -> Column:
    v = column(v)
    return F.sqrt(_folded(F.transform(v["values"] if kind is SPARSE else v, lambda x: x.cast("double") * x.cast("double"))))


l2_norm = vector_norm


def _out_of_range(as_type: str, why: str) -> Column:
    return fail(f"value out of range: {why}", as_type=as_type)


def _finished(values: Column, kind: Kind) -> Column:
    """Doubles as elements of the kind; what doesn't fit is an overflow."""
    rounded = F.transform(values, lambda x: half_round(x) if kind is HALF else x.cast("float").cast("double"))
    limit = F.lit(HALF_MAX) if kind is HALF else F.lit(3.4028234663852886e38)
    checked = lambda r: F.when(F.exists(r, lambda x: F.isnan(x) | (F.abs(x) > limit)), _out_of_range("array<float>", "overflow")).otherwise(r.cast("array<float>"))
    return _bound(rounded, checked)


def l2_normalize(v, kind: Kind = VECTOR) -> Column:
    v = column(v)
    norm = vector_norm(v, kind)
    if kind is SPARSE:
        scaled = lambda n: F.filter(F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(i.alias("i"), (x.cast("double") / n).cast("float").alias("x"))), lambda e: e["x"] != 0)
        made = lambda es: F.struct(v["dim"].alias("dim"), F.transform(es, lambda e: e["i"]).alias("indices"), F.transform(es, lambda e: e["x"]).alias("values"))
        return F.when(v.isNull(), None).when(F.size(v["values"]) == 0, v).otherwise(_bound(norm, lambda n: _bound(scaled(n), made)))
    return F.when(v.isNull(), None).otherwise(_bound(norm, lambda n: F.when(n > 0, _finished(F.transform(v, lambda x: x.cast("double") / n), kind)).otherwise(F.transform(v, lambda x: F.lit(0.0).cast("float")))))


def binary_quantize(v, kind: Kind = VECTOR) -> Column:
    """bit: whether each element is above 0."""
    v = column(v)
    return F.when(v.isNotNull(), pack_bits(F.transform(v, lambda x: (x > 0).cast("bigint")), F.size(v)))


def pack_bits(bits: Column, n: Column) -> Column:
    """bit of an array of 0 and 1."""
    word = lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
    count = F.floor((n + 63) / 64).cast("int")
    left = (64 - (n % 64)) % 64
    words = F.when(count == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda w: F.when(w == count - 1, F.call_function("shiftleft", word(w), left)).otherwise(word(w))))
    return F.struct(n.alias("nbits"), words.alias("words"))


def subvector(v, start, count, kind: Kind = VECTOR) -> Column:
    """count elements from start (from 1); the window is cut to the vector, and must leave something."""
    v = column(v)
    start, count = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (start, count))
    first = F.greatest(start, F.lit(1).cast("bigint"))
    end = F.least(start + count, F.size(v) + F.lit(1).cast("bigint"))
    empty = (count < 1) | (first > F.size(v)) | (end <= first)
    return F.when(empty, fail(f"{kind.name} must have at least 1 dimension", as_type=kind.sql)).otherwise(F.slice(v, first.cast("int"), F.greatest(end - first, F.lit(0).cast("bigint")).cast("int")))


def _elementwise(a, b, kind: Kind, f: Callable[[Column, Column], Column]) -> Column:
    a, b = column(a), column(b)
    return same_dims(a, b, kind, _finished(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), kind), kind.sql)


def vector_add(a, b, kind: Kind = VECTOR) -> Column:
    return _elementwise(a, b, kind, lambda x, y: x + y)


def vector_sub(a, b, kind: Kind = VECTOR) -> Column:
    return _elementwise(a, b, kind, lambda x, y: x - y)


def vector_mul(a, b, kind: Kind = VECTOR) -> Column:
    a, b = column(a), column(b)
    product = _elementwise(a, b, kind, lambda x, y: x * y)
    lost = F.exists(F.zip_with(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0)), product, lambda used, r: used & (r == 0)), lambda x: x)
    return F.when(lost, _out_of_range(kind.sql, "underflow")).otherwise(product)


def vector_concat(a, b, kind: Kind = VECTOR) -> Column:
    return checked_dims(F.concat(column(a), column(b)), kind)


def sort_key(v) -> Column:
    """Orders sparse vectors of equal length as their dense forms order: negatives by index, then positives from the last index down."""
    v = column(v)
    one = lambda sign, i, x: F.struct(F.lit(sign).alias("s"), i.alias("i"), x.alias("x"))
    entry = F.zip_with(v["indices"], v["values"], lambda i, x: F.when(x < 0, one(-1, i, x)).otherwise(one(1, -i, x)))
    end = F.array(one(0, F.lit(0), F.lit(0.0).cast("float")))
    return F.when(v.isNotNull(), F.struct(F.concat(entry, end).alias("entries"), v["dim"].alias("dim")))


def _ordered(v: Column, kind: Kind) -> Column:
    return sort_key(v) if kind is SPARSE else v


def _comparison(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def compare(a, b, kind: Kind = VECTOR) -> Column:
        return f(_ordered(column(a), kind), _ordered(column(b), kind))

    return compare


lt, le, eq = _comparison(lambda a, b: a < b), _comparison(lambda a, b: a <= b), _comparison(lambda a, b: a == b)
ne, ge, gt = _comparison(lambda a, b: a != b), _comparison(lambda a, b: a >= b), _comparison(lambda a, b: a > b)
compare = _comparison(lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a.isNotNull() & b.isNotNull(), 0))


def order_by(v, kind: Kind = VECTOR) -> Column:
    """A sort order: nulls last."""
    return _ordered(column(v), kind).asc_nulls_last()


def hamming_distance(a, b) -> Column:
    a, b = column(a), column(b)
    apart = F.aggregate(F.zip_with(a["words"], b["words"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return same_dims(a, b, BIT, apart.cast("double"), "double")


def jaccard_distance(a, b) -> Column:
    a, b = column(a), column(b)
    ones = lambda words: F.aggregate(F.transform(words, F.bit_count), F.lit(0), lambda s, x: s + x).cast("double")
    parts = F.struct(ones(F.zip_with(a["words"], b["words"], lambda x, y: x.bitwiseAND(y))).alias("ab"), ones(a["words"]).alias("a"), ones(b["words"]).alias("b"))
    value = _bound(parts, lambda p: F.when(p["ab"] == 0, F.lit(1.0)).otherwise(1 - p["ab"] / (p["a"] + p["b"] - p["ab"])))
    return same_dims(a, b, BIT, F.when(a.isNotNull() & b.isNotNull(), value), "double")


# Casts


def bit_from_text(text) -> Column:
    """bit of a string of 0 and 1."""
    text = column(text)
    bits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("bigint"))
    wrong = F.regexp_extract(text, "([^01])", 1)
    return F.when(text.rlike("[^01]"), fail('"', wrong, '" is not a valid binary digit', as_type=BIT.sql)).when(text.isNotNull(), pack_bits(bits, F.length(text)))


def bit_to_text(v) -> Column:
    v = column(v)
    one = lambda i: F.call_function("shiftright", F.element_at(v["words"], F.floor(i / 64).cast("int") + 1), 63 - i % 64).bitwiseAND(F.lit(1)).cast("string")
    return F.when(v.isNull(), None).when(v["nbits"] == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(v["nbits"] - 1, F.lit(0))), one), ""))


def _whole(a: Column, kind: Kind) -> Column:
    """An array of numbers as floats of the kind, or an error."""
    checked = lambda floats: (
        F.when(F.exists(floats, lambda x: x.isNull()), fail("array must not contain nulls", as_type="array<float>"))
        .when(F.exists(floats, lambda x: F.isnan(x)), fail(f"NaN not allowed in {kind.name}", as_type="array<float>"))
        .when(F.exists(floats, lambda x: F.abs(x) == float("inf")), fail(f"infinite value not allowed in {kind.name}", as_type="array<float>"))
        .otherwise(floats)
    )
    return _bound(F.transform(a, lambda x: x.cast("double").cast("float")), checked)


def array_to_vector(a, dim: int | None = None) -> Column:
    """vector of an array of integers, floats, doubles or decimals."""
    v = checked_dims(_whole(column(a), VECTOR), VECTOR)
    return v if dim is None else _cut(v, dim, VECTOR)


def _cut(v: Column, dim: int, kind: Kind) -> Column:
    from .kinds import assert_dims

    return assert_dims(v, dim, kind)


def _halved(v: Column) -> Column:
    def checked(w: Column) -> Column:
        large = F.filter(w, lambda x: F.abs(half_round(x)) > HALF_MAX)
        wrong = fail('"', F.regexp_replace(F.get(large, F.lit(0)).cast("string"), r"\.0$", ""), '" is out of range for type halfvec', as_type="array<float>")
        return F.when(F.size(large) > 0, wrong).otherwise(F.transform(w, half_round).cast("array<float>"))

    return _bound(v, checked)


def array_to_halfvec(a, dim: int | None = None) -> Column:
    v = _halved(checked_dims(_whole(column(a), HALF), HALF))
    return v if dim is None else _cut(v, dim, HALF)


def vector_to_halfvec(v, dim: int | None = None) -> Column:
    v = _halved(column(v))
    return v if dim is None else _cut(v, dim, HALF)


def halfvec_to_vector(v, dim: int | None = None) -> Column:
    v = column(v)
    return v if dim is None else _cut(v, dim, VECTOR)


def to_float_array(v) -> Column:
    return column(v).cast("array<float>")


def vector_to_sparsevec(v, dim: int | None = None) -> Column:
    v = column(v)
    kept = F.filter(F.transform(v, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    made = F.struct(F.size(v).alias("dim"), F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["x"]).alias("values"))
    over = F.size(kept) > MAX_NONZERO
    s = F.when(over, fail(f"sparsevec cannot have more than {MAX_NONZERO} non-zero elements", as_type=SPARSE.sql)).when(v.isNotNull(), made)
    return s if dim is None else _cut(s, dim, SPARSE)


halfvec_to_sparsevec = vector_to_sparsevec


def array_to_sparsevec(a, dim: int | None = None) -> Column:
    v = _whole(column(a), SPARSE)
    empty = F.when(F.size(v) < 1, fail("sparsevec must have at least 1 dimension", as_type="array<float>")).otherwise(v)
    return vector_to_sparsevec(empty, dim)


def sparsevec_to_vector(v, dim: int | None = None, kind: Kind = VECTOR) -> Column:
    v = column(v)
    # from one index to the next: the gap's zeros, then the value
    before = F.concat(F.array(F.lit(0)), v["indices"])
    gaps = F.zip_with(v["indices"], F.slice(before, 1, F.size(v["indices"])), lambda i, p: i - p - 1)
    pieces = F.zip_with(gaps, v["values"], lambda n, x: F.concat(F.array_repeat(F.lit(0.0).cast("float"), n), F.array(x)))
    rest = v["dim"] - F.element_at(before, -1)
    dense = F.concat(F.flatten(pieces), F.array_repeat(F.lit(0.0).cast("float"), rest))
    too_long = F.when(v["dim"] > kind.max_dim, fail(f"{kind.name} cannot have more than {kind.max_dim} dimensions", as_type="array<float>")).when(v.isNotNull(), dense)
    return too_long if dim is None else _cut(too_long, dim, kind)


def sparsevec_to_halfvec(v, dim: int | None = None) -> Column:
    h = _halved(sparsevec_to_vector(v, None, HALF))
    return h if dim is None else _cut(h, dim, HALF)
