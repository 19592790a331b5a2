"""Payload changes: a new version of the source table with registered fields of given rows set or deleted.

Tables of files have no update, so each function gives the changed DataFrame and a report; the caller registers or
writes it. A change is one pass with an expression per column, no shuffle beyond the join with the keys.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.errors import InvalidParameter, UnknownPayloadField, UnknownPoint, WrongColumnType
from vantor.plans.filters import Field
from vantor.sources.catalog import Catalog, Collection

_MUTABLE = (T.StringType, T.BooleanType, T.NumericType)


def _fields(c: Collection, keys: Sequence[str]) -> dict[str, Field]:
    for k in keys:
        if k not in c.fields:
            raise InvalidParameter(f"filter key {k} isn't registered")
    return {k: c.fields[k] for k in keys}


def _hit(catalog: Catalog, c: Collection, keys: Sequence[str]) -> DataFrame:
    """The keys' active points; a key without one is an error."""
    wanted = catalog._keys(list(keys))
    found = wanted.join(catalog.active(c), "source_key", "left_semi").join(catalog.source(c).select(F.col("id").cast("string").alias("source_key")), "source_key", "left_semi")
    if missing := wanted.join(found, "source_key", "left_anti").take(1):
        raise UnknownPoint(f"no active point {missing[0][0]}")
    return found


def _json_edit(column: str, edits: Mapping[tuple[str, ...], object], delete: bool) -> Column:
    """JSON text with paths set (created where missing, arrays left alone) or removed; Arrow batches, as Spark has no such expression."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                if delete:
                    return None
                value: object = {}
            else:
                value = json.loads(text)
            for path, new in edits.items():
                at = value
                for p in path[:-1]:
                    if isinstance(at, dict):
                        if not isinstance(at.get(p), (dict, list)):
                            if delete or p in at:
                                at = None
                                break
                            at[p] = {}
                        at = at[p]
                    elif isinstance(at, list) and p.lstrip("-").isdigit() and -len(at) <= int(p) < len(at):
                        at = at[int(p)]
                    else:
                        at = None
                        break
                if isinstance(at, dict):
                    if delete:
                        at.pop(path[-1], None)
                    else:
                        at[path[-1]] = new
                elif isinstance(at, list) and path[-1].lstrip("-").isdigit() and -len(at) <= int(path[-1]) < len(at):
                    if delete:
                        del at[int(path[-1])]
                    else:
                        at[int(path[-1])] = new
            return json.dumps(value, ensure_ascii=False)

        return texts.map(one)

    return run(F.col(f"`{column}`"))


def _apply(catalog: Catalog, c: Collection, keys: Sequence[str], values: Mapping[str, object], delete: bool) -> tuple[DataFrame, DataFrame]:
    source, fields = catalog.source(c), _fields(c, list(values))
    hit = _hit(catalog, c, keys)
    marked = source.join(hit.select(F.col("source_key").alias("_key"), F.lit(True).alias("_hit")), F.col("id").cast("string") == F.col("_key"), "left").drop("_key")
    paths: dict[str, dict[tuple[str, ...], object]] = {}
    for k, f in fields.items():
        if f.column not in source.columns:
            raise UnknownPayloadField(f"column {f.column} doesn't exist")
        part = source.schema[f.column]
        if f.path is not None:
            paths.setdefault(f.column, {})[f.path] = values[k]
            continue
        if not isinstance(part.dataType, _MUTABLE):
            raise WrongColumnType(f"{f.column} can't be changed")
        if (delete or values[k] is None) and not part.nullable:
            raise InvalidParameter(f"{f.column} must not be null")
        new = F.lit(None if delete else values[k]).cast(part.dataType)
        marked = marked.withColumn(f.column, F.when(F.col("_hit"), new).otherwise(F.col(f"`{f.column}`")))
    names = [F.col(f"`{n}`") for n in source.columns]
    if not paths:
        return marked.select(*names), hit.withColumn("updated", F.lit(True))
    # JSON is edited by Python, which is given the rows that change and no others
    rows = marked.where("_hit")
    for column, edits in paths.items():
        rows = rows.withColumn(column, _json_edit(column, edits, delete))
    return rows.select(*names).unionByName(marked.where(F.col("_hit").isNull()).select(*names)), hit.withColumn("updated", F.lit(True))


def set_payload(catalog: Catalog, collection: str, keys: Sequence[str], payload: Mapping[str, object]) -> tuple[DataFrame, DataFrame]:
    """(source table with the fields set in the keys' rows, report of (source_key, updated))."""
    if not payload:
        raise InvalidParameter("empty payload")
    return _apply(catalog, catalog.exact(collection), keys, payload, delete=False)


def delete_payload(catalog: Catalog, collection: str, keys: Sequence[str], payload_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """As set_payload: columns become null, JSON paths are removed; a column that must not be null refuses."""
    if not payload_keys:
        raise InvalidParameter("no payload keys")
    return _apply(catalog, catalog.exact(collection), keys, dict.fromkeys(payload_keys), delete=True)


def clear_payload(catalog: Catalog, collection: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """delete_payload of all registered fields."""
    c = catalog.exact(collection)
    return _apply(catalog, c, keys, dict.fromkeys(c.fields), delete=True)
