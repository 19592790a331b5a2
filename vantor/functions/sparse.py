"""Sparse vectors: struct(dims, indices, values) with indices from 1, sorted and unique; the text form is {1:0.5,3:2}/10."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, InvalidVector, UnsupportedMetric
from vantor.functions import vectors

TYPE = "struct<dims:int,indices:array<int>,values:array<float>>"


@dataclass(frozen=True)
class Sparse:
    """A constant sparse vector."""

    dims: int
    indices: tuple[int, ...]
    values: tuple[float, ...]

    def __post_init__(self) -> None:
        if not 1 <= self.dims <= vectors.MAX_DIMENSIONS:
            raise InvalidVector("bad number of dimensions")
        if len(self.indices) != len(self.values) or any(a >= b for a, b in zip(self.indices, self.indices[1:], strict=False)):
            raise InvalidVector("indices must be sorted and unique, one for each value")
        if self.indices and not 1 <= self.indices[0] <= self.indices[-1] <= self.dims:
            raise InvalidVector("index out of range")
        if self.values:
            vectors.check_vector(self.values)

    @classmethod
    def parse(cls, text: str) -> Sparse:
        m = re.fullmatch(r"\s*\{([^}]*)\}\s*/\s*(\d+)\s*", text)
        if not m:
            raise InvalidVector(f"malformed sparse vector {text!r}")
        pairs = []
        for item in filter(None, (x.strip() for x in m[1].split(","))):
            e = re.fullmatch(rf"(\d+)\s*:\s*({vectors._NUMBER})", item)
            if not e:
                raise InvalidVector(f"malformed entry {item!r}")
            pairs.append((int(e[1]), float(e[2])))
        pairs.sort()
        return cls(int(m[2]), tuple(i for i, _ in pairs), tuple(v for _, v in pairs))

    def __str__(self) -> str:
        return "{" + ",".join(f"{i}:{v!r}".removesuffix(".0") for i, v in zip(self.indices, self.values, strict=True)) + f"}}/{self.dims}"

    def column(self) -> Column:
        indices = F.array(*(F.lit(i) for i in self.indices)).cast("array<int>")
        return F.struct(F.lit(self.dims).alias("dims"), indices.alias("indices"), vectors.constant(self.values).cast("array<double>").alias("values"))


Operand = Sparse | Column


def _col(v: Operand) -> Column:
    return v.column() if isinstance(v, Sparse) else v


def parse(text: Column) -> Column:
    """A sparse vector from its text form; errors as for constants."""
    good = text.rlike(rf"^\s*\{{\s*(?:\d+\s*:\s*{vectors._NUMBER}(?:\s*,\s*\d+\s*:\s*{vectors._NUMBER})*)?\s*\}}\s*/\s*\d+\s*$")
    entries = F.filter(F.split(F.regexp_extract(text, r"\{(.*)\}", 1), ","), lambda x: F.trim(x) != "")
    pairs = F.array_sort(F.transform(entries, lambda x: F.struct(F.trim(F.element_at(F.split(x, ":"), 1)).cast("int").alias("i"), F.trim(F.element_at(F.split(x, ":"), 2)).cast("float").alias("v"))))
    parts = _let(pairs, lambda p: F.struct(F.transform(p, lambda e: e["i"]).alias("i"), F.transform(p, lambda e: e["v"]).alias("v"), F.regexp_extract(text, r"/\s*(\d+)", 1).cast("int").alias("d")))
    built = _let(parts, lambda p: from_arrays(p["i"], p["v"], p["d"]))
    return F.when(good, built).when(good.isNotNull(), vectors.error("22P02: malformed sparse vector", TYPE))


def from_arrays(indices: Column, values: Column, dims: Column | int) -> Column:
    """From sorted unique indices (from 1), values and dims."""
    dims = F.lit(dims) if isinstance(dims, int) else dims
    sorted_ = (F.size(F.array_distinct(indices)) == F.size(indices)) & (F.array_sort(indices) == indices)
    inside = F.forall(indices, lambda i: (i >= 1) & (i <= dims))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size(indices) == F.size(values)) & sorted_ & inside & finite & dims.between(1, vectors.MAX_DIMENSIONS)
    built = F.struct(dims.cast("int").alias("dims"), indices.cast("array<int>").alias("indices"), values.cast("array<float>").alias("values"))
    return F.when(good, built).when(good.isNotNull(), vectors.error("22P02: invalid sparse vector", TYPE))


def from_vector(v: Column) -> Column:
    """The values of a dense vector that aren't zero."""
    pairs = F.filter(F.transform(v, lambda x, i: F.struct((i + 1).cast("int").alias("i"), x.alias("v"))), lambda p: p["v"] != 0)
    built = F.struct(F.size(v).alias("dims"), F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).cast("array<float>").alias("values"))
    return F.when(v.isNotNull(), built)


def to_vector(v: Column) -> Column:
    dense = _let(v, lambda s: _let(F.map_from_arrays(s["indices"], s["values"]), lambda m: F.transform(F.sequence(F.lit(1), s["dims"]), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)).cast("float"))))
    return F.when(v.isNotNull(), dense)


def to_text(v: Column) -> Column:
    pairs = F.zip_with(v["indices"], v["values"], lambda i, x: F.concat(i.cast("string"), F.lit(":"), vectors._plain(x)))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}/"), v["dims"].cast("string"))


def dims(v: Column) -> Column:
    return v["dims"]


def indices(v: Column) -> Column:
    return v["indices"]


def values(v: Column) -> Column:
    return v["values"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though the body uses it within other functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_lookup(v: Operand, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body of a function from an index to v's value there, null where v has no entry."""
    if isinstance(v, Sparse):
        have = dict(zip(v.indices, v.values, strict=True))
        dense = F.array(*(F.lit(have.get(i)).cast("double") for i in range(1, v.dims + 1)))
        return body(lambda i: F.get(dense, i - 1))
    return _let(F.map_from_arrays(v["indices"], v["values"].cast("array<double>")), lambda m: body(lambda i: F.try_element_at(m, i)))


def _checked(a: Operand, b: Operand, value: Column) -> Column:
    same = _col(a)["dims"] == _col(b)["dims"]
    return F.when(same, value).when(same.isNotNull(), vectors.error("22023: dimension mismatch"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def _terms(a: Operand, b: Operand, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of term(x, y) over the entries of either; entries that one lacks are 0 there."""
    ca, cb = _col(a), _col(b)

    def body(in_a: Callable[[Column], Column], in_b: Callable[[Column], Column]) -> Column:
        one = F.zip_with(ca["indices"], ca["values"], lambda i, x: term(x.cast("double"), F.coalesce(in_b(i), F.lit(0.0))))
        rest = F.zip_with(cb["indices"], cb["values"], lambda i, y: F.when(in_a(i).isNotNull(), 0.0).otherwise(term(F.lit(0.0), y.cast("double"))))
        return _sum(one) + _sum(rest)

    return _checked(a, b, _with_lookup(a, lambda in_a: _with_lookup(b, lambda in_b: body(in_a, in_b))))


def inner_product(a: Operand, b: Operand) -> Column:
    ca = _col(a)
    return _checked(a, b, _with_lookup(b, lambda in_b: _sum(F.zip_with(ca["indices"], ca["values"], lambda i, x: x.cast("double") * F.coalesce(in_b(i), F.lit(0.0))))))


def negative_inner_product(a: Operand, b: Operand) -> Column:
    return -inner_product(a, b)


def l2_distance(a: Operand, b: Operand) -> Column:
    return F.sqrt(_terms(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Operand, b: Operand) -> Column:
    return _terms(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a: Operand, b: Operand) -> Column:
    norms = vectors.squared_norm(_col(a)["values"]) * vectors.squared_norm(_col(b)["values"])
    return F.when(norms > 0, 1.0 - inner_product(a, b) / F.sqrt(norms)).when(norms.isNotNull(), vectors.error("22P02: zero vector has no direction"))


def distance(metric: str, a: Operand, b: Operand) -> Column:
    known = {"l2": l2_distance, "inner_product": negative_inner_product, "cosine": cosine_distance, "l1": l1_distance}
    if metric in ("hamming", "jaccard"):
        raise UnsupportedMetric(f"{metric} isn't a metric of sparse vectors here")
    if metric not in known:
        raise InvalidParameter(f"unknown metric {metric}")
    return known[metric](a, b)


def compare(a: Column, b: Column) -> Column:
    """By entries (index, value) from the first on, then fewer entries first, then fewer dimensions."""
    left, right = (F.struct(F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(i.alias("i"), x.alias("x"))).alias("e"), v["dims"].alias("d")) for v in (a, b))
    return F.when(a.isNotNull() & b.isNotNull(), vectors.compare(left, right))


def literal(v: Sparse | str | Sequence[float]) -> Sparse:
    """A constant from a Sparse, its text form, or dense values."""
    if isinstance(v, Sparse):
        return v
    if isinstance(v, str):
        return Sparse.parse(v)
    dense = vectors.check_vector(v)
    return Sparse(len(dense), tuple(i + 1 for i, x in enumerate(dense) if x), tuple(x for x in dense if x))
