"""Bit vectors: arrays of boolean; the text form is 1011."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.functions import vectors
from vantor.functions.vectors import compare, dims

__all__ = ["compare", "dims", "from_bool_array", "hamming_distance", "jaccard_distance", "parse", "to_bool_array", "to_text"]


def parse(text: Column) -> Column:
    good = text.rlike(r"^[01]{1,16000}$")
    return F.when(good, F.transform(F.split(text, ""), lambda x: x == "1")).when(good.isNotNull(), vectors.error("22P02: malformed bit vector", "array<boolean>"))


def to_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.when(x, "1").otherwise("0")), "")


def from_bool_array(v: Column) -> Column:
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    return F.when(good, v).when(v.isNotNull(), vectors.error("22P02: a bit vector needs bits", "array<boolean>"))


def to_bool_array(v: Column) -> Column:
    return v


def _count(a: Column, b: Column, test) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: test(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    same = F.size(a) == F.size(b)
    return F.when(same, total).when(same.isNotNull(), vectors.error("22023: dimension mismatch", "int"))


def hamming_distance(a: Column, b: Column) -> Column:
    return _count(a, b, lambda x, y: x != y)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - shared / set bits; 0 if neither has a set bit."""
    either = _count(a, b, lambda x, y: x | y)
    return F.when(either == 0, 0.0).otherwise(1.0 - _count(a, b, lambda x, y: x & y) / either)
