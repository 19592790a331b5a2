"""Scalar functions for use in SQL, defined as SQL functions so that they are inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_SQUARES = "aggregate({0}, 0D, (s, x) -> s + x * x)"
_SAME = "CASE WHEN size(a) = size(b) THEN {0} WHEN size(a) IS NULL OR size(b) IS NULL THEN NULL ELSE raise_error('22023: dimension mismatch') END"
_NORMS = f"{_SQUARES.format('a')} * {_SQUARES.format('b')}"
_V = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_B = "a ARRAY<BOOLEAN>, b ARRAY<BOOLEAN>"
_BITS = "aggregate(zip_with(a, b, (x, y) -> CAST({0} AS INT)), 0, (s, x) -> s + x)"
_S = "STRUCT<dims: INT, indices: ARRAY<INT>, values: ARRAY<FLOAT>>"
_SP = f"a {_S}, b {_S}"
_KIND = "CASE WHEN a.dims = b.dims THEN {0} WHEN a.dims IS NULL OR b.dims IS NULL THEN NULL ELSE raise_error('22023: dimension mismatch') END"
#: The value that the other vector has at a term, 0 where it has none.
_AT = "coalesce(CAST(element_at(map_from_arrays({0}.indices, {0}.values), i) AS DOUBLE), 0D)"
_SDOT = f"aggregate(zip_with(a.indices, a.values, (i, x) -> CAST(x AS DOUBLE) * {_AT.format('b')}), 0D, (s, x) -> s + x)"
_SQ = "aggregate({0}.values, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
_ALONE = "aggregate(zip_with({0}.indices, {0}.values, (i, x) -> CASE WHEN array_contains({1}.indices, i) THEN 0D ELSE {2} END), 0D, (s, x) -> s + x)"


def _terms(both: str, one: str) -> str:
    """A sum over the terms of either sparse vector: `both` of x and y where a has the term, `one` of x where only b has it."""
    return f"aggregate(zip_with(a.indices, a.values, (i, x) -> {both.format(x='CAST(x AS DOUBLE)', y=_AT.format('b'))}), 0D, (s, x) -> s + x) + {_ALONE.format('b', 'a', one.format(x='CAST(x AS DOUBLE)'))}"


#: binary16 rounding of a value x, to nearest, ties to even.
_HALF = "CASE WHEN x = 0 THEN 0D ELSE rint(x / pow(2D, greatest(floor(log2(abs(x))), -14) - 10)) * pow(2D, greatest(floor(log2(abs(x))), -14) - 10) END"
#: name -> (parameters, type, body)
FUNCTIONS = {
    "l2_distance": (_V, "DOUBLE", _SAME.format("sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")),
    "l1_distance": (_V, "DOUBLE", _SAME.format("aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)")),
    "inner_product": (_V, "DOUBLE", _SAME.format(_DOT)),
    "negative_inner_product": (_V, "DOUBLE", "-" + "(" + _SAME.format(_DOT) + ")"),
    "cosine_distance": (_V, "DOUBLE", _SAME.format(f"CASE WHEN {_NORMS} > 0 THEN 1 - {_DOT} / sqrt({_NORMS}) ELSE raise_error('22P02: zero vector has no direction') END")),
    "vector_dims": ("a ARRAY<DOUBLE>", "INT", "size(a)"),
    "vector_cmp": (_V, "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    "hamming_distance": (_B, "INT", _SAME.format(_BITS.format("x <> y"))),
    "jaccard_distance": (_B, "DOUBLE", _SAME.format(f"CASE WHEN {_BITS.format('x OR y')} = 0 THEN 0D ELSE 1D - {_BITS.format('x AND y')} / {_BITS.format('x OR y')} END")),
    "binary_quantize": ("a ARRAY<DOUBLE>", "ARRAY<BOOLEAN>", "transform(a, x -> x >= 0)"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_SQUARES.format('a')})"),
    "vector_lt": (_V, "BOOLEAN", "a < b"), "vector_le": (_V, "BOOLEAN", "a <= b"), "vector_eq": (_V, "BOOLEAN", "a = b"), "vector_ne": (_V, "BOOLEAN", "a <> b"), "vector_ge": (_V, "BOOLEAN", "a >= b"), "vector_gt": (_V, "BOOLEAN", "a > b"),
    "to_halfvec": ("a ARRAY<DOUBLE>", "ARRAY<FLOAT>", f"transform(transform(a, x -> {_HALF}), x -> CASE WHEN abs(x) <= 65504 THEN CAST(x AS FLOAT) ELSE raise_error('22003: value out of range of half precision') END)"),
    "bit_cmp": (_B, "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    "bit_text": ("a ARRAY<BOOLEAN>", "STRING", "array_join(transform(a, x -> CASE WHEN x THEN '1' ELSE '0' END), '')"),
    "bit_count_set": ("a ARRAY<BOOLEAN>", "INT", "size(filter(a, x -> x))"),
    "sparsevec_dims": (f"a {_S}", "INT", "a.dims"), "sparsevec_nnz": (f"a {_S}", "INT", "size(a.indices)"), "sparsevec_norm": (f"a {_S}", "DOUBLE", f"sqrt({_SQ.format('a')})"),
    "sparsevec_inner_product": (_SP, "DOUBLE", _KIND.format(_SDOT)), "sparsevec_negative_inner_product": (_SP, "DOUBLE", _KIND.format("-(" + _SDOT + ")")),
    "sparsevec_l2_distance": (_SP, "DOUBLE", _KIND.format("sqrt(" + _terms("({x} - {y}) * ({x} - {y})", "{x} * {x}") + ")")), "sparsevec_l1_distance": (_SP, "DOUBLE", _KIND.format(_terms("abs({x} - {y})", "abs({x})"))),
    "sparsevec_cosine_distance": (_SP, "DOUBLE", _KIND.format(f"CASE WHEN {_SQ.format('a')} * {_SQ.format('b')} > 0 THEN 1 - {_SDOT} / sqrt({_SQ.format('a')} * {_SQ.format('b')}) ELSE raise_error('22P02: zero vector has no direction') END")),
    "sparsevec_to_vector": (f"a {_S}", "ARRAY<FLOAT>", "transform(sequence(1, a.dims), i -> CAST(" + _AT.format("a") + " AS FLOAT))"),
}


def register(spark: SparkSession) -> list[str]:
    """Defines the functions for this session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
