"""Owned token sets for late interaction: the array column of a source table, one row per token, kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.errors import InvalidParameter, UnknownPayloadField, WrongColumnType
from vantor.functions.vectors import error
from vantor.sources.catalog import Catalog
from vantor.sources.versioned import VersionedTable


def explode_tokens(source: DataFrame, column: str, dims: int | None = None) -> DataFrame:
    """Rows (source_key, token_ordinal, token): one per token, from 1 on; null arrays and tokens give none, another dimension is an error."""
    if column not in source.columns:
        raise UnknownPayloadField(f"column {column} doesn't exist")
    kind = source.schema[column].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)):
        raise WrongColumnType(f"{column} isn't an array of vectors")
    rows = source.select(F.col("id").cast("string").alias("source_key"), F.posexplode(f"`{column}`").alias("_p", "token"))
    token = F.col("token") if dims is None else F.when(F.size("token") == dims, F.col("token")).otherwise(error("22023: dimension mismatch", kind.elementType.simpleString()))
    return rows.where(F.col("token").isNotNull()).select("source_key", (F.col("_p") + 1).alias("token_ordinal"), token.alias("token"))


def register_late_interaction(catalog: Catalog, collection: str, column: str, path: str | None = None) -> DataFrame:
    """Registers a token column; with a path its tokens are also written there as a versioned table. One row (collection, dimensions, point_count, token_count, status)."""
    c = catalog.exact(collection)
    source = catalog.source(c)
    first = explode_tokens(source, column).select(F.size("token")).first()
    if first is None:
        raise InvalidParameter("the column has no tokens")
    tokens = explode_tokens(source, column, first[0])
    counts = tokens.agg(F.countDistinct("source_key"), F.count(F.lit(1))).first()  # also checks the dimensions
    if path is not None:
        VersionedTable(catalog.spark, path).commit(tokens)
    c.tokens = (c.table, column)
    return catalog.spark.createDataFrame([(c.name, int(first[0]), counts[0], counts[1], "ready")], "collection string, dimensions int, point_count bigint, token_count bigint, status string")


def repair_late_interaction(catalog: Catalog, collection: str, path: str) -> DataFrame:
    """Writes the token table anew from the source as its next version. One row as for registration."""
    c = catalog.exact(collection)
    if c.tokens is None:
        raise InvalidParameter("the collection has no registered tokens")
    tokens = explode_tokens(catalog.source(c), c.tokens[1])
    VersionedTable(catalog.spark, path).replace(tokens)
    r = tokens.agg(F.max(F.size("token")), F.countDistinct("source_key"), F.count(F.lit(1))).first()
    return catalog.spark.createDataFrame([(c.name, r[0], r[1], r[2], "repaired")], "collection string, dimensions int, point_count bigint, token_count bigint, status string")
