"""Golden cases of the scalar functions, casts, text and binary forms."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.functions import aggregates as A
from orthant.functions import expr as E
from orthant.functions.kinds import BIT, HALF, SPARSE, VECTOR, VectorError, kind_of, parse_type, with_kind
from orthant.sources import text as X

V = E.lit_vector
INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(c):
        return one.select(c.alias("x")).first()[0]

    return get


def H(values):
    return E.array_to_halfvec(F.array(*(F.lit(float(x)) for x in values)))


def SP(text):
    n, indices, values = X.parse_sparse(text)
    return F.struct(F.lit(n).alias("dim"), F.array(*map(F.lit, indices)).cast("array<int>").alias("indices"), F.array(*map(F.lit, values)).cast("array<float>").alias("values"))


def B(text):
    return E.bit_from_text(F.lit(text))


def golden():
    """name -> (expression, value); columns need a session, so they are made late."""
    NULL = F.lit(None).cast("array<float>")
    return {
        "l2": (E.l2_distance(V([0, 0]), V([3, 4])), 5.0), "l2 nine": (E.l2_distance(V([1] * 9), V([1] * 7 + [4, 5])), 5.0), "l2 overflow": (E.l2_distance(V([3e38]), V([-3e38])), INF), "l2 null": (E.l2_distance(V([1]), NULL), None),
        "l2 squared": (E.l2_squared_distance(V([0, 0]), V([3, 4])), 25.0), "ip": (E.inner_product(V([1, 2]), V([3, 4])), 11.0), "ip overflow": (E.inner_product(V([3e38]), V([3e38])), INF), "-ip": (E.negative_inner_product(V([1, 2]), V([3, 4])), -11.0),
        "cosine": (E.cosine_distance(V([1, 2]), V([2, 4])), 0.0), "cosine zero": (E.cosine_distance(V([1, 2]), V([0, 0])), NAN), "cosine right": (E.cosine_distance(V([1, 0]), V([0, 2])), 1.0), "cosine opposite": (E.cosine_distance(V([1, 1]), V([-1, -1])), 2.0),
        "cosine clamp": (E.cosine_distance(V([1, 1]), V([-1.1, -1.1])), 2.0), "cosine overflow": (E.cosine_distance(V([3e38]), V([3e38])), NAN), "cosine underflow": (E.cosine_distance(V([1e-30]), V([1e-30])), NAN), "cosine null": (E.cosine_distance(V([1]), NULL), None),
        "l1": (E.l1_distance(V([0, 0]), V([3, 4])), 7.0), "l1 overflow": (E.l1_distance(V([3e38]), V([-3e38])), INF), "spherical": (E.spherical_distance(V([1, 0]), V([0, 1])), 0.5), "dims": (E.vector_dims(V([1, 2, 3])), 3),
        "norm": (E.vector_norm(V([3, 4])), 5.0), "norm wide": (E.vector_norm(V([3e37, 4e37])), pytest.approx(5e37)), "normalize": (E.l2_normalize(V([3, 4])), pytest.approx([0.6, 0.8])), "normalize zero": (E.l2_normalize(V([0, 0])), [0.0, 0.0]), "normalize wide": (E.l2_normalize(V([3e38])), [1.0]), "normalize null": (E.l2_normalize(NULL), None),
        "quantize": (E.bit_to_text(E.binary_quantize(V([0, 0.1, -0.2, -0.3, 0.4, 0.5, 0.6, -0.7, 0.8, -0.9, 1]))), "01001110101"),
        "sub 1 3": (E.subvector(V([1, 2, 3, 4, 5]), 1, 3), [1, 2, 3]), "sub 3 2": (E.subvector(V([1, 2, 3, 4, 5]), 3, 2), [3, 4]), "sub -1 3": (E.subvector(V([1, 2, 3, 4, 5]), -1, 3), [1]), "sub 3 9": (E.subvector(V([1, 2, 3, 4, 5]), 3, 9), [3, 4, 5]),
        "sub 3 max": (E.subvector(V([1, 2, 3, 4, 5]), 3, 2147483647), [3, 4, 5]), "sub min max": (E.subvector(V([1, 2, 3, 4, 5]), -2147483644, 2147483647), [1, 2]),
        "add": (E.vector_add(V([1, 2, 3]), V([4, 5, 6])), [5, 7, 9]), "minus": (E.vector_sub(V([1, 2, 3]), V([4, 5, 6])), [-3, -3, -3]), "times": (E.vector_mul(V([1, 2, 3]), V([4, 5, 6])), [4, 10, 18]), "concat": (E.vector_concat(V([1, 2]), V([3])), [1, 2, 3]),
        "lt": (E.lt(V([1, 2]), V([1, 2, 3])), True), "eq zeros": (E.eq(V([0.0]), V([-0.0])), True), "cmp": (E.compare(V([1, 3]), V([1, 2, 3])), 1), "cmp null": (E.compare(V([1]), NULL), None), "ne": (E.ne(V([1]), V([1])), False), "ge": (E.ge(V([1]), V([1])), True), "le": (E.le(V([2]), V([1])), False), "gt": (E.gt(V([2]), V([1])), True),
        "half": (H([65519, 1e-8, -1e-8]), [65504.0, 0.0, -0.0]), "half add": (E.vector_add(H([1, 2]), H([3, 4]), HALF), [4, 6]), "half normalize": (E.l2_normalize(H([3, 4]), HALF), [float(np.float16(0.6)), float(np.float16(0.8))]), "half l2": (E.l2_distance(H([0, 0]), H([3, 4]), HALF), 5.0),
        "sparse l2": (E.l2_distance(SP("{1:1,2:2}/3"), SP("{2:4,3:1}/3"), SPARSE), pytest.approx(6**0.5)), "sparse empty": (E.l2_distance(SP("{}/2"), SP("{1:3,2:4}/2"), SPARSE), 5.0), "sparse ip": (E.inner_product(SP("{1:1,2:2}/2"), SP("{1:2,2:4}/2"), SPARSE), 10.0), "sparse cosine": (E.cosine_distance(SP("{1:1,2:2}/2"), SP("{1:2,2:4}/2"), SPARSE), 0.0),
        "sparse cosine zero": (E.cosine_distance(SP("{1:1}/2"), SP("{}/2"), SPARSE), NAN), "sparse l1": (E.l1_distance(SP("{1:1,2:2}/3"), SP("{2:4,3:1}/3"), SPARSE), 4.0), "sparse norm": (E.l2_norm(SP("{1:3,2:4}/2"), SPARSE), 5.0), "sparse lt": (E.lt(SP("{}/2"), SP("{1:1}/2"), SPARSE), True), "sparse negative": (E.lt(SP("{1:-1}/2"), SP("{}/2"), SPARSE), True),
        "hamming": (E.hamming_distance(B("111"), B("100")), 2.0), "hamming long": (E.hamming_distance(B("10" * 256 + "1"), B("01" * 256 + "0")), 513.0), "hamming empty": (E.hamming_distance(B(""), B("")), 0.0), "jaccard": (E.jaccard_distance(B("1111"), B("1110")), 0.25), "jaccard zero": (E.jaccard_distance(B("1100"), B("0011")), 1.0), "jaccard empty": (E.jaccard_distance(B(""), B("")), 1.0),
        "to sparse": (E.vector_to_sparsevec(V([0, 1.5, 0, 3.5, 0])), (5, [2, 4], [1.5, 3.5])), "from sparse": (E.sparsevec_to_vector(SP("{2:1.5,4:3.5}/5")), [0, 1.5, 0, 3.5, 0]), "from empty": (E.sparsevec_to_vector(SP("{}/3")), [0, 0, 0]), "sparse to half": (E.sparsevec_to_halfvec(SP("{2:1.5}/2")), [0, 1.5]),
        "tiny array": (E.array_to_vector(F.array(F.lit(1e-46), F.lit(-1e-46))), [0.0, -0.0]), "ints": (E.array_to_vector(F.array(*map(F.lit, (1, 2, 3)))), [1, 2, 3]),
    }


def test_golden(value):
    for name, (c, expected) in golden().items():
        got = value(c)
        if isinstance(expected, float) and expected != expected:
            assert got != got, name
        elif isinstance(expected, tuple):
            assert (got.dim, got.indices, got["values"]) == expected, name
        else:
            assert got == expected, name
            if isinstance(expected, list):
                assert [np.signbit(x) for x in got] == [np.signbit(x) for x in expected], name


def errors():
    return {
        "different vector dimensions 2 and 1": [f(V([1, 2]), V([3])) for f in (E.l2_distance, E.inner_product, E.cosine_distance, E.l1_distance, E.vector_add, E.vector_sub, E.vector_mul)],
        "different halfvec dimensions 2 and 1": [E.l2_distance(H([1, 2]), H([3]), HALF)],
        "different sparsevec dimensions 2 and 1": [E.l1_distance(SP("{1:1,2:2}/2"), SP("{1:3}/1"), SPARSE)],
        "different bit lengths 3 and 2": [E.hamming_distance(B("111"), B("00"))],
        "different bit lengths 4 and 3": [E.jaccard_distance(B("1111"), B("000"))],
        "value out of range: overflow": [E.vector_add(V([3e38]), V([3e38])), E.vector_sub(V([-3e38]), V([3e38])), E.vector_mul(V([1e37]), V([1e37])), E.vector_mul(H([65519]), H([65519]), HALF)],
        "value out of range: underflow": [E.vector_mul(V([1e-37]), V([1e-37])), E.vector_mul(H([1e-7]), H([1e-7]), HALF)],
        "vector must have at least 1 dimension": [*(E.subvector(V([1, 2, 3, 4, 5]), a, n) for a, n in ((1, 0), (3, -1), (-1, 2), (2147483647, 10))), E.array_to_vector(F.array().cast("array<double>"))],
        "vector cannot have more than 16000 dimensions": [E.vector_concat(F.array_repeat(F.lit(0.0).cast("float"), 16000), V([1])), E.sparsevec_to_vector(SP("{}/16001"))],
        "expected 2 dimensions, not 3": [E.array_to_vector(F.array(*map(F.lit, (1, 2, 3))), 2), E.vector_to_halfvec(V([1, 2, 3]), 2), E.halfvec_to_vector(V([1, 2, 3]), 2)],
        "expected 4 dimensions, not 5": [E.vector_to_sparsevec(V([0, 1.5, 0, 3.5, 0]), 4), E.sparsevec_to_vector(SP("{2:1.5,4:3.5}/5"), 4)],
        "array must not contain nulls": [E.array_to_vector(F.array(F.lit(None).cast("float")))],
        "NaN not allowed in vector": [E.array_to_vector(F.array(F.lit(NAN)))],
        "infinite value not allowed in vector": [E.array_to_vector(F.array(F.lit(INF))), E.array_to_vector(F.array(F.lit(4e38)))],
        '"65520" is out of range for type halfvec': [H([65520]), E.vector_to_halfvec(V([65520])), E.sparsevec_to_halfvec(SP("{1:65520}/1"))],
    }


def test_errors(value):
    for message, columns in errors().items():
        for c in columns:
            with pytest.raises(Exception, match=re.escape(message)):
                value(c)


PARSED = {
    "[1,2,3]": [1, 2, 3], " [ 1,  2 ,    3  ] ": [1, 2, 3], "[1.,2.,3.]": [1, 2, 3], "[1.23456]": [float(np.float32(1.23456))], "[1e-46]": [0], "[-1e-46]": [-0.0],
}
NOT_PARSED = {
    "[hello,1]": "invalid input syntax for type vector", "[NaN,1]": "NaN not allowed in vector", "[Infinity,1]": "infinite value not allowed", "[-Infinity,1]": "infinite value not allowed", "[4e38,1]": '"4e38" is out of range for type vector', "[1,2,3": "invalid input", "[1,2,3]9": "Junk after closing right brace",
    "1,2,3": 'Vector contents must start with "["', "": "invalid input", "[": "invalid input", "[ ": "invalid input", "[,": "invalid input", "[]": "vector must have at least 1 dimension", "[ ]": "at least 1 dimension", "[,]": "invalid input", "[1,]": "invalid input", "[1a]": "invalid input", "[1,,3]": "invalid input", "[1, ,3]": "invalid input", "[1f]": "invalid input",
}
SPARSE_NOT_PARSED = {
    "": "start with", "{": "invalid", "{}": "Unexpected end of input", "{}/": "invalid", "{}/1a": "Junk after closing", "{:}/1": "invalid", "{1,}/1": "invalid", "{:1}/1": "invalid", "{1:}/1": "invalid", "{1:1,}/1": "invalid", "{1a:1}/1": "invalid", "{1:1a}/1": "invalid", "{0:1}/1": "index out of bounds", "{2:1}/1": "index out of bounds",
    "{-2147483649:1}/1": "index out of bounds", "{1:1,1:1}/2": "must not contain duplicates", "{1:1,2:1,1:1}/2": "must not contain duplicates", "{}/0": "at least 1 dimension", "{}/-1": "at least 1 dimension", "{}/1000000001": "cannot have more than 1000000000 dimensions", "{1:1e-46,2:1}/2": '"1e-46" is out of range', "{1:NaN,2:1}/2": "NaN not allowed",
}


def test_parsing():
    for text, expected in PARSED.items():
        got = X.parse_dense(text)
        assert got == expected and [np.signbit(x) for x in got] == [np.signbit(x) for x in expected]
    for text, message in NOT_PARSED.items():
        with pytest.raises(VectorError, match=re.escape(message)):
            X.parse_dense(text)
    assert X.parse_sparse(" { 1 : 1.5 ,  3  :  3.5  } / 5 ") == (5, [1, 3], [1.5, 3.5]) and X.parse_sparse("{2:0,1:1}/2") == (2, [1], [1.0])
    for text, message in SPARSE_NOT_PARSED.items():
        with pytest.raises(VectorError, match=re.escape(message)):
            X.parse_sparse(text)
    assert X.parse_dense("[65519,1e-8]", HALF) == [65504.0, 0.0]
    with pytest.raises(VectorError, match='"65520" is out of range for type halfvec'):
        X.parse_dense("[65520,-65520]", HALF)


def test_formatting_and_fuzz():
    assert X.format_dense([1, 2.5, -0.0, 1.5e38, 1.5e-38, 123456, 1e6, 0.0001, 0.00001]) == "[1,2.5,-0,1.5e+38,1.5e-38,123456,1e+06,0.0001,1e-05]"
    r = random.Random(0)
    for _ in range(300):
        values = [float(np.float32(r.uniform(-1, 1) * 10 ** r.randrange(-38, 38))) for _ in range(r.randrange(1, 5))]
        assert X.parse_dense(X.format_dense(values)) == values
        for seed, parse in (("[1.23,4.56,7.89]", X.parse_dense), ("{1:1.23,2:4.56,3:7.89}/3", X.parse_sparse)):
            text = list(seed)
            for _ in range(r.randrange(1, 3)):
                text[r.randrange(len(text)) : r.randrange(len(text) + 1)] = r.choice(["", "9", ",", "e", "[", "}", ".", " ", "-"])
            try:
                parse("".join(text))
            except VectorError as e:
                assert "vector" in str(e) or "sparsevec" in str(e) or "dimension" in str(e)


def test_binary_forms():
    assert X.decode_dense(X.encode_dense([1, 2.5, -0.0])) == [1, 2.5, -0.0] and X.encode_dense([1.0]) == b"\x00\x01\x00\x00\x3f\x80\x00\x00" and X.encode_dense([1.0], HALF) == b"\x00\x01\x00\x00\x3c\x00"
    assert X.decode_sparse(X.encode_sparse(5, [2, 4], [1.5, 3.5])) == (5, [2, 4], [1.5, 3.5])
    for bad in (b"\x00\x01\x00\x01\x3f\x80\x00\x00", b"\x00\x00\x00\x00", b"\x00\x01\x00\x00\x7f\x80\x00\x00", b"\x00\x02\x00\x00\x3f\x80\x00\x00"):
        with pytest.raises(VectorError):
            X.decode_dense(bad)


def test_types():
    assert parse_type("vector(3)") == (VECTOR, 3) and parse_type("sparsevec") == (SPARSE, None) and parse_type("bit(8)") == (BIT, 8)
    for text, message in {"vector(0)": "must be at least 1", "vector(16001)": "cannot exceed 16000", "vector('a')": 'invalid input syntax for type integer: "a"', "vector(3, 2)": "invalid type modifier", "sparsevec(1000000001)": "cannot exceed 1000000000"}.items():
        with pytest.raises(VectorError, match=re.escape(message)):
            parse_type(text)


def test_typed_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    typed = with_kind(df, "v", "halfvec(2)")
    assert kind_of(typed, "v") == (HALF, 2) and typed.count() == 2
    with pytest.raises(Exception, match="expected 3 dimensions, not 2"):
        with_kind(df, "v", "vector(3)").collect()


def test_text_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "[1,2.5]", "{1:1}/2", "01"), (2, None, None, None)], "id int, d string, s string, b string")
    typed = df.select("id", X.from_text("d").alias("d"), X.from_text("s", SPARSE).alias("s"), X.from_text("b", BIT).alias("b"))
    back = typed.select("id", X.to_text("d").alias("d"), X.to_text("s", SPARSE).alias("s"), X.to_text("b", BIT).alias("b"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    X.write_text(typed.select("id", "d"), str(tmp_path / "csv"), {"d": "vector(2)"}, sep="\t")
    assert X.read_text(spark, str(tmp_path / "csv"), "id int, d string", {"d": "vector(2)"}, sep="\t").where("id = 1").first().d == [1.0, 2.5]
    binary = typed.select("id", X.from_binary(X.to_binary("d")).alias("d"))
    assert {r.id: r.d for r in binary.collect()} == {1: [1.0, 2.5], 2: None}


def test_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [3.0, 5.0, 7.0]), (1, None), (2, None)], "g int, v array<float>")
    assert {r.g: r.avg for r in A.vector_avg(df, "v", ["g"]).collect()} == {1: [2, 3.5, 5], 2: None}
    assert A.vector_sum(df, "v").first()[0] == [4, 7, 10] and A.vector_avg(df.limit(0), "v").first()[0] is None
    assert {r.g: r.avg for r in A._exploded(df, ["g"], "v", False, VECTOR, "avg").collect()} == {1: [2, 3.5, 5], 2: None}
    big = spark.createDataFrame([([3e38],), ([3e38],)], "v array<float>")
    assert A.vector_avg(big, "v").first()[0] == [float(np.float32(3e38))]
    mixed = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "v array<float>")
    for run, message in ((lambda: A.vector_sum(big, "v"), "value out of range: overflow"), (lambda: A.vector_avg(mixed, "v", dim=2), "expected 2 dimensions, not 1"), (lambda: A.vector_sum(mixed, "v", dim=2), "different vector dimensions 2 and 1"), (lambda: A.halfvec_sum(spark.createDataFrame([([65504.0],)] * 2, "v array<float>"), "v"), "value out of range: overflow")):
        with pytest.raises(Exception, match=message):
            run().collect()
    assert "partial_sum" in A.vector_avg(df, "v", ["g"], dim=3)._jdf.queryExecution().toString()


def test_aggregate_states(value):
    state = E.column(A.combine_states(A.accumulate_state(V([1, 2])), A.accumulate_state(V([3, 6]))))
    assert value(state) == [2, 4, 8] and value(A.final_avg(state)) == [2, 4]
    assert value(A.final_avg(F.array(F.lit(0.0)))) is None


def test_order_agrees_with_arrays(spark):
    r = random.Random(1)
    rows = [([float(r.randrange(-1, 1)) for _ in range(3)], [float(r.randrange(-1, 1)) for _ in range(r.randrange(2, 5))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").select("a", "b", E.compare("a", "b").alias("c"))
    assert all(x.c == (x.a > x.b) - (x.a < x.b) for x in df.collect())
    rows = [([float(r.choice([-2, -1, 0, 0, 1])) for _ in range(4)], [float(r.choice([-2, -1, 0, 0, 1])) for _ in range(4)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    s = df.select("a", "b", E.vector_to_sparsevec("a").alias("x"), E.vector_to_sparsevec("b").alias("y")).select("a", "b", E.compare("x", "y", SPARSE).alias("c"), *(f("x", "y", SPARSE).alias(n) for n, f in (("l2", E.l2_distance), ("ip", E.inner_product), ("l1", E.l1_distance))), *(f("a", "b").alias("d" + n) for n, f in (("l2", E.l2_distance), ("ip", E.inner_product), ("l1", E.l1_distance))))
    assert all(x.c == (x.a > x.b) - (x.a < x.b) and (x.l2, x.ip, x.l1) == (x.dl2, x.dip, x.dl1) for x in s.collect())


def test_nulls_last(spark):
    df = spark.createDataFrame([([0.0],), ([1.0],), (None,), ([-1.0],)], "v array<float>")
    assert [r.v for r in df.orderBy(E.order_by("v")).collect()] == [[-1.0], [0.0], [1.0], None]
