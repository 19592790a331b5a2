"""The metadata-filter language: JSON text to a tree, and the tree to a Column that Catalyst can push down.

A filter is an object with the lists must, should and must_not; their members are conditions {"key": ..., predicate} or
nested filters. Keys must be registered, as a column or as a path in a JSON column. Nulls follow SQL's three-valued logic.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.errors import InvalidFilter, UnknownPayloadField, WrongColumnType

MAX_DEPTH, MAX_NODES, MAX_KEY_BYTES, MAX_SEGMENTS = 16, 256, 512, 16
Scalar = str | int | float | bool | None


@dataclass(frozen=True)
class Field:
    """Where a key's values are: a column, or a path in a column of JSON text."""

    column: str
    path: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Match:
    key: str
    value: Scalar


@dataclass(frozen=True)
class MatchAny:
    key: str
    values: tuple[Scalar, ...]
    negated: bool


@dataclass(frozen=True)
class Range:
    key: str
    bounds: tuple[tuple[str, str | int | float], ...]


@dataclass(frozen=True)
class Is:
    key: str
    what: str
    wanted: bool


@dataclass(frozen=True)
class Group:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


def check_key(key: str) -> str:
    parts = key.split(".")
    if not key or len(key.encode()) > MAX_KEY_BYTES or len(parts) > MAX_SEGMENTS or "\0" in key or not all(parts):
        raise InvalidFilter(f"malformed key {key!r}")
    return key


def parse(text: str | Mapping) -> Group:
    """The tree of a filter given as JSON text or as the object."""
    try:
        raw = json.loads(text) if isinstance(text, str) else text
    except json.JSONDecodeError as e:
        raise InvalidFilter(f"a filter must be JSON: {e}") from e
    count = [0]
    return _group(raw, 1, count)


def _group(raw: object, depth: int, count: list[int]) -> Group:
    if depth > MAX_DEPTH:
        raise InvalidFilter("filter is nested too deeply")
    if not isinstance(raw, Mapping) or not raw:
        raise InvalidFilter("a filter must be an object with must, should or must_not")
    if unknown := set(raw) - {"must", "should", "must_not"}:
        raise InvalidFilter(f"unknown clause {sorted(unknown)[0]}")
    lists = {}
    for name, items in raw.items():
        if not isinstance(items, list):
            raise InvalidFilter(f"{name} must be a list")
        lists[name] = tuple(_member(x, depth, count) for x in items)
    out = Group(**lists)
    if not (out.must or out.should or out.must_not):
        raise InvalidFilter("filter without conditions")
    return out


def _member(raw: object, depth: int, count: list[int]) -> object:
    count[0] += 1
    if count[0] > MAX_NODES:
        raise InvalidFilter("filter has too many conditions")
    if not isinstance(raw, Mapping):
        raise InvalidFilter("a condition must be an object")
    if "key" not in raw:
        return _group(raw, depth + 1, count)
    if not isinstance(raw["key"], str):
        raise InvalidFilter("a key must be a string")
    key, out = check_key(raw["key"]), None
    for name in sorted(raw):  # of several predicates in one condition the last by name holds
        if name == "key":
            continue
        value = raw[name]
        if name == "match":
            out = _match(key, value)
        elif name == "range":
            out = _range(key, value)
        elif name in ("is_null", "is_empty"):
            if not isinstance(value, bool):
                raise InvalidFilter(f"{name} needs true or false")
            out = Is(key, name, value)
        else:
            raise InvalidFilter(f"unknown predicate {name}")
    if out is None:
        raise InvalidFilter("condition without predicate")
    return out


def _scalar(value: object) -> Scalar:
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise InvalidFilter("a value must be a scalar")
    return value


def _match(key: str, raw: object) -> Match | MatchAny:
    if not isinstance(raw, Mapping):
        return Match(key, _scalar(raw))
    if set(raw) == {"value"}:
        return Match(key, _scalar(raw["value"]))
    for name in ("any", "except"):
        if set(raw) == {name}:
            if not isinstance(raw[name], list) or not raw[name]:
                raise InvalidFilter(f"{name} needs a list that isn't empty")
            return MatchAny(key, tuple(_scalar(x) for x in raw[name]), name == "except")
    raise InvalidFilter("match needs value, any or except")


def _range(key: str, raw: object) -> Range:
    if not isinstance(raw, Mapping) or not raw or set(raw) - {"gt", "gte", "lt", "lte"}:
        raise InvalidFilter("range needs gt, gte, lt or lte")
    for v in raw.values():
        if isinstance(v, bool) or not isinstance(v, (str, int, float)):
            raise InvalidFilter("a bound must be a number or a string")
    return Range(key, tuple((k, raw[k]) for k in ("gt", "gte", "lt", "lte") if k in raw))


_COMPARE = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def json_path(path: tuple[str, ...]) -> str:
    """The path expression of a path's segments."""
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)


class Compiler:
    """Compiles trees against registered fields and a schema."""

    def __init__(self, fields: Mapping[str, Field], schema: T.StructType) -> None:
        self.fields, self.schema = fields, schema

    def compile(self, node: Group | str | Mapping) -> Column:
        return self._node(node if isinstance(node, Group) else parse(node))

    def field(self, key: str) -> Field:
        if key not in self.fields:
            raise UnknownPayloadField(f"filter key {key} isn't registered")
        f = self.fields[key]
        if f.column not in self.schema.fieldNames():
            raise UnknownPayloadField(f"column {f.column} doesn't exist")
        return f

    def text(self, key: str) -> Column:
        """A key's value as text, null where it is missing or a JSON null."""
        f = self.field(key)
        if f.path is None:
            return F.col(f"`{f.column}`").cast("string")
        return F.try_variant_get(F.try_parse_json(F.col(f"`{f.column}`")), json_path(f.path), "string")

    def _node(self, n: object) -> Column:
        if isinstance(n, Group):
            parts = [self._node(x) for x in n.must]
            if n.should:
                parts.append(reduce(lambda a, b: a | b, (self._node(x) for x in n.should)))
            parts += [~self._node(x) for x in n.must_not]
            return reduce(lambda a, b: a & b, parts)
        f = self.field(n.key)
        return self._json(f, n) if f.path is not None else self._plain(f, n)

    def _plain(self, f: Field, n: object) -> Column:
        col, kind = F.col(f"`{f.column}`"), self.schema[f.column].dataType
        if isinstance(n, Match):
            if n.value is None:
                raise InvalidFilter("null doesn't match; use is_null")
            return col == self._literal(n.value, kind)
        if isinstance(n, MatchAny):
            if len({"n" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__ for v in n.values}) > 1 or None in n.values:
                raise InvalidFilter("the values of a list must be of one type")
            inside = col.isin([self._literal(v, kind) for v in n.values])
            return ~inside if n.negated else inside
        if isinstance(n, Range):
            return reduce(lambda a, b: a & b, (_COMPARE[op](col, self._literal(v, kind)) for op, v in n.bounds))
        if n.what == "is_null":
            return col.isNull() if n.wanted else col.isNotNull()
        if not isinstance(kind, T.StringType):
            raise InvalidFilter("is_empty needs a text column")
        return col == "" if n.wanted else col != ""

    def _literal(self, value: str | int | float | bool, kind: T.DataType) -> Column:
        numeric, boolean = isinstance(kind, T.NumericType), isinstance(kind, T.BooleanType)
        if isinstance(value, bool):
            if not boolean:
                raise InvalidFilter("a truth value needs a boolean column")
        elif isinstance(value, (int, float)):
            if not numeric:
                raise InvalidFilter("a number needs a numeric column")
            return F.lit(value)
        elif numeric or boolean:
            raise InvalidFilter("a string needs a text or time column")
        elif not isinstance(kind, T.StringType):
            return F.lit(value).cast(kind)
        return F.lit(value)

    def _json(self, f: Field, n: object) -> Column:
        """Typed comparison: a string never equals a number, whatever its digits."""
        if not isinstance(self.schema[f.column].dataType, T.StringType):
            raise WrongColumnType(f"{f.column} isn't a column of JSON text")
        whole, path = F.try_parse_json(F.col(f"`{f.column}`")), json_path(f.path)
        value = F.try_variant_get(whole, path, "variant")
        kind = F.schema_of_variant(value)

        def equal(v: Scalar) -> Column:
            if v is None:
                return kind == "VOID"
            if isinstance(v, bool):
                return F.when(kind == "BOOLEAN", F.try_variant_get(whole, path, "boolean") == v).otherwise(False)
            if isinstance(v, str):
                return F.when(kind == "STRING", F.try_variant_get(whole, path, "string") == v).otherwise(False)
            return F.when(_number(kind), F.try_variant_get(whole, path, "double") == float(v)).otherwise(False)

        def known(c: Column) -> Column:
            return F.when(value.isNotNull(), c)  # a missing path is null

        if isinstance(n, Match):
            return known(equal(n.value))
        if isinstance(n, MatchAny):
            hit = reduce(lambda a, b: a | b, (equal(v) for v in n.values))
            return known(~hit if n.negated else hit)
        if isinstance(n, Range):
            parts = []
            for op, v in n.bounds:
                good, typed = (kind == "STRING", "string") if isinstance(v, str) else (_number(kind), "double")
                parts.append(F.when(good, _COMPARE[op](F.try_variant_get(whole, path, typed), F.lit(v))).otherwise(False))
            return known(reduce(lambda a, b: a & b, parts))
        if n.what == "is_null":
            return value.isNull() if n.wanted else value.isNotNull()
        return known(equal("") if n.wanted else ~equal(""))


def _number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
