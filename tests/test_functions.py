import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, InvalidVector, OutOfRange, UnsupportedMetric
from vantor.functions import bits, half, quantize, register, sparse, vectors
from vantor.operators import aggregates, text


def one(spark, column, *rows, schema="v array<double>"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column.alias("x")).collect()]


def test_distances_against_constants_and_columns(spark):
    rows = [([1.0, 2.0], [3.0, 5.0]), ([0.5, -1.0], [0.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    for f, want in (
        (vectors.l2_distance, lambda x, y: np.linalg.norm(x - y)), (vectors.l1_distance, lambda x, y: abs(x - y).sum()), (vectors.inner_product, lambda x, y: x @ y),
        (vectors.cosine_distance, lambda x, y: 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)),
    ):
        got = [r[0] for r in df.select(f(a, b)).collect()]
        assert got == pytest.approx([want(np.array(x), np.array(y)) for x, y in rows])
        got = [r[0] for r in df.select(f(a, [1.0, 4.0])).collect()]
        assert got == pytest.approx([want(np.array(x), np.array([1.0, 4.0])) for x, _ in rows])
        assert [r[0] for r in df.select(f([1.0, 4.0], a)).collect()] == pytest.approx(got)
    long = np.random.default_rng(0).random((2, 300))
    assert one(spark, vectors.l2_distance(F.col("v"), long[1].tolist()), long[0].tolist())[0] == pytest.approx(np.linalg.norm(long[0] - long[1]))


def test_distance_nulls_and_errors(spark):
    v = F.col("v")
    assert one(spark, vectors.l2_distance(v, [1.0, 2.0]), None, [1.0, 2.0]) == [None, 0.0]
    for bad in (vectors.l2_distance(v, [1.0]), vectors.inner_product(v, F.array(F.lit(1.0))), vectors.cosine_distance(v, [0.0, 0.0])):
        with pytest.raises(PySparkException, match="22023|22P02"):
            one(spark, bad, [1.0, 2.0])
    with pytest.raises(InvalidVector):
        vectors.check_vector([math.nan])
    with pytest.raises(InvalidVector):
        vectors.check_vector([])
    with pytest.raises(InvalidParameter):
        vectors.distance("euclid", v, [1.0])
    with pytest.raises(UnsupportedMetric) as e:
        vectors.distance("hamming", v, [1.0])
    assert e.value.sqlstate == "0A000"


def test_text_form_and_conversions(spark):
    assert one(spark, vectors.parse(F.col("v")), "[1,2.5,-3]", " [ 1e-2 , .5 ] ", None, schema="v string") == [[1.0, 2.5, -3.0], [pytest.approx(0.01), 0.5], None]
    assert one(spark, vectors.to_text(F.col("v")), [1.0, 2.5, -3.0]) == ["[1,2.5,-3]"]
    for bad in ("[]", "[1,]", "1,2", "[a]", "[1e99]"):
        with pytest.raises(PySparkException, match="22P02"):
            one(spark, vectors.parse(F.col("v")), bad, schema="v string")
    assert one(spark, vectors.from_exact_array(F.col("v")), [0.5, 2.0]) == [[0.5, 2.0]]
    with pytest.raises(PySparkException, match="22003"):
        one(spark, vectors.from_exact_array(F.col("v")), [0.1])
    with pytest.raises(OutOfRange):
        vectors.exact_float([0.1])
    with pytest.raises(PySparkException, match="22023"):
        one(spark, vectors.enforce_dims(F.col("v").cast("array<float>"), 3), [1.0])
    assert one(spark, vectors.compare(F.col("v"), F.array(F.lit(1.0), F.lit(2.0))), [1.0], [1.0, 2.0], [1.0, 3.0], None) == [-1, 0, 1, None]
    assert one(spark, vectors.binary_distance("jaccard", F.col("v"), F.array(F.lit(1.0), F.lit(1.0))), [1.0, 0.0], [0.0, 0.0]) == [0.5, 1.0]


def test_half_rounding_is_binary16(spark):
    values = [0.1, 1 / 3, 2049.0, 2051.0, 6e-8, 5.9e-8, 1e-9, 65504.0, -1.0009765625, 0.0, 1.00048828125]
    got = one(spark, half.round_half(F.col("v")), *values, schema="v double")
    assert got == [float(np.float16(x)) for x in values]
    with pytest.raises(PySparkException, match="22003"):
        one(spark, half.round_half(F.col("v")), 65520.0, schema="v double")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=200))
def test_half_rounding_property(spark, values):
    assert one(spark, half.from_array(F.col("v")), values)[0] == [float(x) for x in np.array(values, np.float16)]


def test_sparse(spark):
    s = sparse.Sparse.parse("{1:0.5,3:2}/10")
    assert str(s) == "{1:0.5,3:2}/10" and s.dims == 10
    for bad in ("{0:1}/3", "{4:1}/3", "{1:1,1:2}/3", "1:2/3", "{1:x}/3"):
        with pytest.raises(InvalidVector):
            sparse.Sparse.parse(bad)
    c = sparse.parse(F.col("v"))
    df = spark.createDataFrame([("{1:1,2:-2}/10",), ("{}/10",), ("{3:2}/10",), (None,)], "v string").select(c.alias("s"))
    col = F.col("s")
    assert [r[0] for r in df.select(sparse.inner_product(col, s)).collect()] == [0.5, 0.0, 4.0, None]
    assert [r[0] for r in df.select(sparse.l1_distance(col, s)).collect()] == [4.5, 2.5, 0.5, None]
    assert [r[0] for r in df.select(sparse.l2_distance(col, col)).collect()] == [0.0, 0.0, 0.0, None]
    assert [r[0] for r in df.select(sparse.to_text(col)).collect()] == ["{1:1,2:-2}/10", "{}/10", "{3:2}/10", None]
    assert [r[0] for r in df.select(sparse.compare(col, s.column().cast(sparse.TYPE))).collect()] == [1, -1, 1, None]
    dense = df.select(sparse.to_vector(col).alias("d"))
    assert dense.first()[0] == [1.0, -2.0] + [0.0] * 8
    assert dense.where("d is not null").select(sparse.to_text(sparse.from_vector(F.col("d")))).first()[0] == "{1:1,2:-2}/10"
    with pytest.raises(PySparkException, match="22P02"):
        spark.createDataFrame([("{2:1,2:3}/4",)], "v string").select(c).collect()
    with pytest.raises(PySparkException, match="22023"):
        df.select(sparse.inner_product(col, sparse.Sparse.parse("{1:1}/3"))).collect()


def test_bits(spark):
    df = spark.createDataFrame([("1011", "1001"), ("0000", "0000"), (None, "1")], "a string, b string").select(bits.parse(F.col("a")).alias("a"), bits.parse(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(bits.hamming_distance(a, b), bits.jaccard_distance(a, b), bits.to_text(a)).collect()] == [(1, pytest.approx(1 / 3), "1011"), (0, 0.0, "0000"), (None, None, None)]
    with pytest.raises(PySparkException, match="22P02"):
        spark.createDataFrame([("12",)], "a string").select(bits.parse(F.col("a"))).collect()


def test_quantization(spark):
    v = F.col("v")
    assert one(spark, quantize.scalar_quantize(v, 0.0, 1.0, 3), [-1.0, 0.25, 0.5, 2.0]) == [[0, 1, 1, 2]]
    assert one(spark, quantize.scalar_reconstruct(quantize.scalar_quantize(v, 0.0, 1.0, 3), 0.0, 1.0, 3), [0.6]) == [[0.5]]
    books = [[[0.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [0.0, 0.0]]]
    assert one(spark, quantize.product_quantize(v, 2, books), [0.9, 0.8, 5.0, 5.0]) == [[1, 0]]
    assert one(spark, quantize.product_reconstruct(quantize.product_quantize(v, 2, books), 2, books), [0.9, 0.8, 5.0, 5.0]) == [[1.0, 1.0, 0.0, 0.0]]
    assert one(spark, quantize.binary_quantize(v), [0.0, -0.1]) == [[True, False]]
    df = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "id int, v array<double>")
    low, high = quantize.train_scalar(df, "v")
    assert low == 2.0 < high < 2.000001
    rows = spark.createDataFrame([(i, [float(i // 5), 0.0]) for i in range(10)], "id int, v array<double>")
    assert sorted(quantize.train_product(rows, "v", "id", 1, 2)[0]) == [[0.0], [1.0]]
    with pytest.raises(InvalidParameter):
        quantize.scalar_quantize(v, 1.0, 1.0)


def test_aggregates(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", None), ("b", None), (None, [5.0, 6.0])], "k string, v array<double>")
    for dims in (2, None):
        got = {r[0]: r[1] for r in aggregates.aggregate_vectors(df, ["k"], "v", "avg", dims).collect()}
        assert got == {"a": [2.0, 3.0], "b": None, None: [5.0, 6.0]}
        assert aggregates.aggregate_vectors(df, [], "v", "sum", dims).first()[0] == [9.0, 12.0]
        assert aggregates.aggregate_vectors(df.limit(0), [], "v", "sum", dims).first()[0] is None
        mixed = df.unionByName(spark.createDataFrame([("a", [1.0])], df.schema))
        with pytest.raises(PySparkException, match="22023"):
            aggregates.aggregate_vectors(mixed, ["k"], "v", "avg", dims).collect()
    s = df.where("v is not null").select("k", sparse.from_vector(F.col("v")).alias("v"))
    got = {r[0]: r[1] for r in aggregates.aggregate_sparse(s, ["k"], "v", "sum").collect()}
    assert got["a"] == (2, [1, 2], [4.0, 6.0])
    bit = spark.createDataFrame([("a", [True, False]), ("a", [True, True])], "k string, v array<boolean>")
    assert aggregates.aggregate_bits(bit, ["k"], "v", "or", 2).first()[1] == [True, True]
    assert aggregates.aggregate_bits(bit, ["k"], "v", "and").first()[1] == [True, False]


def test_sql_functions(spark):
    assert set(register.register(spark)) == set(register.FUNCTIONS)
    r = spark.sql("SELECT l2_distance(array(3D, 4D), array(0D, 0D)), jaccard_distance(array(true, false), array(true, true)), vector_cmp(array(1D), array(1D, 2D))").first()
    assert tuple(r) == (5.0, 0.5, -1)
    with pytest.raises(PySparkException, match="22023"):
        spark.sql("SELECT inner_product(array(1D), array(1D, 2D))").collect()


def covers(tokens, wanted):
    """Brute force: all shortest stretches that hold every term."""
    found = []
    for i in range(len(tokens)):
        for j in range(i, len(tokens)):
            part = tokens[i : j + 1]
            if set(wanted) <= set(part) and not set(wanted) <= set(part[1:]) and not set(wanted) <= set(part[:-1]):
                found.append(j - i)
    return 0.1 * sum(1.0 / (d + 2 - len(wanted)) for d in found)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d x".split()), max_size=12), min_size=1, max_size=8))
def test_text_rank(spark, docs):
    df = spark.createDataFrame([(" ".join(d),) for d in docs], "t string")
    for q in ("a", "a b", "A, c b!"):
        wanted = text.query_terms(q)
        got = df.select(text.matches(F.col("t"), q), text.rank(F.col("t"), q)).collect()
        assert [r[0] for r in got] == [set(wanted) <= set(d) for d in docs]
        assert [r[1] for r in got] == pytest.approx([covers(d, wanted) for d in docs])


def test_text_nulls(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [tuple(r) for r in df.select(text.matches(F.col("t"), "a"), text.rank(F.col("t"), "a b"), text.matches(F.col("t"), "...")).collect()] == [(False, 0.0, False)] * 2
