"""Exact search over collections and inline arrays: top-k, grouped, facets, counts, scrolling, recommendation, discovery.

Each function declares one plan: the filter and the score are evaluated at the scan of the source table, so that what is
joined with the points is a key and a number per row, whatever the width of the vectors; then comes an ordered limit
(TakeOrderedAndProject, which merges each task's first rows). Faults of a row, such as another dimension, travel along and
are raised only if the row turns out to have an active point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantor.errors import Corrupt, InvalidParameter, NotReady, UnknownTable
from vantor.functions import scoring, vectors
from vantor.functions import sparse as sparse_
from vantor.operators import ann, graph, late, text
from vantor.operators.aggregates import aggregate_vectors
from vantor.runtime import materialize
from vantor.sources.catalog import MAX_LIMIT, Catalog, Collection, VectorEntry, check_limit

Filter = str | Mapping | None


def top(df: DataFrame, limit: int, descending: bool = False, keep: Sequence[str] = ("point_id", "source_key", "score")) -> DataFrame:
    """The first rows by score, then point_id; null scores are left out."""
    order = F.desc("score") if descending else F.asc("score")
    return df.where(F.col("score").isNotNull()).select(*keep).orderBy(order, F.asc("point_id")).limit(limit)


def project(catalog: Catalog, c: Collection, columns: Mapping[str, Column], filter: Filter = None, ids: Sequence[int] | DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Rows (point_id, source_key, columns) of the active points, restricted to ids, whose source row passes filter and where."""
    source, points = catalog.source(c), catalog.active(c)
    if filter is not None:
        source = source.where(catalog.compiler(c, source.schema).compile(filter))
    if where is not None:
        source = source.where(where)
    if ids is not None:
        points = points.join(_ids(points.sparkSession, ids), "point_id", "left_semi")
    rows = source.select(F.col("id").cast("string").alias("_key"), *(e.alias(n) for n, e in columns.items()))
    return points.join(rows, F.col("source_key") == F.col("_key")).drop("_key")


def _raised(rows: DataFrame) -> DataFrame:
    """rows with the score, or the error of a row's fault. The error names the point, so that no optimizer moves it before the join."""
    told = F.concat(F.col("_fault"), F.lit(" (point "), F.col("point_id").cast("string"), F.lit(")"))
    return rows.withColumn("score", F.when(F.col("_fault").isNull(), F.col("score")).otherwise(F.raise_error(told).cast("double"))).drop("_fault")


_MISMATCH, _ZERO = "22023: dimension mismatch", "22P02: zero vector has no direction"


def _dense(metric: str, column: str, query: Sequence[float]) -> dict[str, Column]:
    """score and _fault of a vector column; the score is one batch function, evaluated once per row."""
    if metric == "cosine" and not any(query):
        raise InvalidParameter("the query vector has no direction")
    v = F.col(f"`{column}`")
    score = scoring.score(metric, v, query)
    fault = F.when(F.size(v) != len(query), _MISMATCH)
    if metric == "cosine":
        fault = fault.when(score == scoring.NO_DIRECTION, _ZERO)
    return {"score": score, "_fault": fault}


def _sparse(metric: str, column: str, query: sparse_.Sparse) -> dict[str, Column]:
    v = F.col(f"`{column}`")
    good = v["dims"] == query.dims
    fault = F.when(~good, _MISMATCH)
    if metric == "cosine":
        if not any(query.values):
            raise InvalidParameter("the query vector has no direction")
        length = vectors.squared_norm(v["values"])
        fault, good = fault.when(length == 0, _ZERO), good & (length > 0)
    return {"score": F.when(good, sparse_.distance(metric, v, query)), "_fault": fault}


def _there(column: str) -> Column:
    return F.col(f"`{column}`").isNotNull()


def _ids(spark: SparkSession, ids: Sequence[int] | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("bigint").alias("point_id"))
    return spark.createDataFrame([(int(i),) for i in ids], "point_id bigint")


#: Rows of an attached index from which on a search uses it unasked.
INDEX_FROM = 100_000


def build_index(catalog: Catalog, collection: str, path: str, name: str | None = None, kind: str = "lists", **options: int) -> ann.AnnIndex | graph.GraphIndex:
    """Builds an index, of lists or a graph, over the active points of a collection's vector and attaches it."""
    c = catalog.resolve(collection)
    e = catalog.vector(c, name)
    rows = project(catalog, c, {"vector": F.col(f"`{e.column}`")}, where=_there(e.column))
    known = {"lists": ann.AnnIndex, "graph": graph.GraphIndex}
    if kind not in known:
        raise InvalidParameter("kind must be lists or graph")
    index = known[kind].build(rows, "point_id", "vector", e.dims, e.metric, path, **options)
    catalog.attach_index(c.name, e.name, path)
    return index


def _found(index: ann.AnnIndex | graph.GraphIndex, query: Sequence[float], limit: int, probes: int, ef: int, allowed: DataFrame | None) -> DataFrame:
    """Rows (point_id, score) that the index offers: all of the probed lists, or what each shard's beam finds, with room for points that are gone."""
    if isinstance(index, ann.AnnIndex):
        return index.scan([query], probes).select("point_id", "score")
    return index.search_many([query], min(MAX_LIMIT, 4 * limit), ef, allowed).select("point_id", "score")


def chosen_index(catalog: Catalog, e: VectorEntry, strategy: str = "auto") -> ann.AnnIndex | graph.GraphIndex | None:
    """The attached index, if a search is to use it; None for the exact search.

    "auto" falls back to the exact search where the index is missing, damaged, of another metric or dimension, or small;
    "index" raises instead.
    """
    if strategy not in ("auto", "exact", "index"):
        raise InvalidParameter("strategy must be auto, exact or index")
    if strategy == "exact" or (e.index is None and strategy == "auto"):
        return None
    if e.index is None:
        raise NotReady("no index is attached")
    index = graph.GraphIndex(catalog.spark, e.index)
    if not index.table.version():
        index = ann.AnnIndex(catalog.spark, e.index)
    try:
        p = index._properties()
        if p["metric"] != e.metric or p["dims"] != e.dims:
            raise NotReady("the index is of another metric or dimension")
    except (NotReady, Corrupt, UnknownTable):
        if strategy == "index":
            raise
        return None
    return index if strategy == "index" or p.get("base_rows", INDEX_FROM) >= INDEX_FROM else None


def search(
    catalog: Catalog, collection: str, vector: Sequence[float], limit: int, *, name: str | None = None, filter: Filter = None, candidates: Sequence[int] | DataFrame | None = None,
    strategy: str = "auto", probes: int = 8, ef: int = 64,
) -> DataFrame:
    """Rows (point_id, source_key, score), nearest first by the registered metric, then point_id.

    Rows whose vector is null are left out; an empty result is no error. A vector of another dimension, or of length zero under cosine, is one.

    strategy: "exact", "index", or "auto", which takes an attached index that is ready once it has INDEX_FROM rows (see
    chosen_index). An index gives the points of the probed lists, or of its graphs' beams of width ef, with exact scores; they are checked against the active
    points, and against filter and candidates, before the first are taken.
    """
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit, len(candidates) if isinstance(candidates, (list, tuple)) else None)
    e = catalog.vector(c, name)
    query = vectors.check_vector(vector, e.dims)
    if (index := chosen_index(catalog, e, strategy)) is not None:
        free = filter is None and candidates is None
        points = catalog.active(c) if free else project(catalog, c, {}, filter, candidates)
        return top(_found(index, query, limit, probes, ef, None if free else points).join(points, "point_id"), limit)
    return top(_raised(project(catalog, c, _dense(e.metric, e.column, query), filter, candidates, _there(e.column))), limit)


def inline(spark: SparkSession, vector: Sequence[float], point_ids: Sequence[int], candidates: Sequence[Sequence[float]], metric: str, limit: int) -> DataFrame:
    """Rows (point_id, score) of the nearest of inline vectors; lists of one length, ids not negative."""
    check_limit(limit)
    query = vectors.check_vector(vector)
    _aligned(point_ids, candidates)
    rows = spark.createDataFrame([(int(i), vectors.check_vector(v, len(query))) for i, v in zip(point_ids, candidates, strict=True)], "point_id bigint, v array<double>")
    scored = rows.select("point_id", scoring.score(metric, F.col("v"), query).alias("score"))
    if metric == "cosine":
        scored = scored.withColumn("score", F.when(F.col("score") != scoring.NO_DIRECTION, F.col("score")).when(F.col("score").isNotNull(), vectors.error(_ZERO)))
    return top(scored, limit, keep=("point_id", "score"))


def rerank_quantized(spark: SparkSession, vector: Sequence[float], point_ids: Sequence[int], originals: Sequence[Sequence[float]], metric: str, limit: int) -> DataFrame:
    """Exact order of candidates that codes have chosen."""
    return inline(spark, vector, point_ids, originals, metric, limit)


def _aligned(ids: Sequence[int], values: Sequence) -> None:
    if len(ids) != len(values):
        raise InvalidParameter("ids and vectors differ in number")
    if any(i < 0 for i in ids):
        raise InvalidParameter("ids must not be negative")


def search_sparse(catalog: Catalog, collection: str, name: str, query: sparse_.Sparse | str, limit: int, filter: Filter = None) -> DataFrame:
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    e, q = catalog.vector(c, name, sparse=True), sparse_.literal(query)
    if q.dims != e.dims:
        raise InvalidParameter(f"expected {e.dims} dimensions, not {q.dims}")
    return top(_raised(project(catalog, c, _sparse(e.metric, e.column, q), filter, None, _there(e.column))), limit)


def inline_sparse(spark: SparkSession, query: sparse_.Sparse | str, point_ids: Sequence[int], candidates: Sequence[sparse_.Sparse | str], metric: str, limit: int) -> DataFrame:
    check_limit(limit)
    _aligned(point_ids, candidates)
    rows = [(int(i), (v.dims, list(v.indices), list(v.values))) for i, v in zip(point_ids, map(sparse_.literal, candidates), strict=True)]
    df = spark.createDataFrame(rows, f"point_id bigint, v {sparse_.TYPE}")
    return top(df.select("point_id", sparse_.distance(metric, F.col("v"), sparse_.literal(query)).alias("score")), limit, keep=("point_id", "score"))


def search_full_text(catalog: Catalog, collection: str, query: str, column: str, limit: int) -> DataFrame:
    """Rows whose text holds all terms, the highest rank first."""
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    text.check_query(query, column)
    _has(catalog.source(c), column)
    rows = project(catalog, c, {"score": text.rank(F.col(column), query)}, where=text.matches(F.col(column), query))
    return top(rows, limit, descending=True)


def search_late_interaction(catalog: Catalog, collection: str, queries: Sequence[Sequence[float]], column: str, limit: int) -> DataFrame:
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    _has(catalog.source(c), column)
    tokens, dims = F.col(f"`{column}`"), len(late.check_queries(queries)[0])
    even = F.forall(tokens, lambda t: F.size(t) == dims)
    fault = F.when(F.coalesce(F.size(tokens), F.lit(0)) < 1, "22023: a row has no tokens").when(~F.coalesce(even, F.lit(False)), _MISMATCH)
    whole = F.when((F.size(tokens) > 0) & even, tokens).otherwise(F.array(F.array_repeat(F.lit(0.0).cast("float"), dims)))
    rows = project(catalog, c, {"score": F.when(fault.isNull(), late.max_sim(whole, queries)), "_fault": fault})
    return top(_raised(rows), limit, descending=True)


def search_late_interaction_tokens(
    catalog: Catalog, collection: str, queries: Sequence[Sequence[float]], tokens: DataFrame, key: str, vector: str, candidates: int, limit: int,
    index: ann.AnnIndex | graph.GraphIndex | None = None, probes: int = 8, ef: int = 64, token: str | None = None,
) -> DataFrame:
    """Late interaction over a table with one row per token: per query vector the `candidates` best tokens choose points, which are then scored over all their tokens.

    All query vectors are scored in one pass at the scan of the tokens, which leaves a key and a number per query vector of
    each token; token vectors don't travel.

    index: an index over the tokens by inner product, of lists with the points' keys as owners, or a graph over the ids in the column
    `token`; it then chooses the points, and only their tokens are scored.
    """
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit, candidates)
    check_limit(candidates)
    wanted = late.check_queries(queries)
    points = catalog.active(c).join(catalog.source(c).select(F.col("id").cast("string").alias("source_key")), "source_key", "left_semi")
    if index is not None:
        if isinstance(index, graph.GraphIndex):
            if token is None:
                raise InvalidParameter("a graph needs the column of the tokens' ids")
            ids = index.search_many(wanted, candidates, ef).select(F.col("point_id").alias("_token")).distinct()
            owners = tokens.join(F.broadcast(ids), F.col(token).cast("bigint") == F.col("_token"), "left_semi").select(F.col(key).cast("string").alias("_key"))
        else:
            owners = index.search_many(wanted, candidates, probes).select(F.col("owner").alias("_key"))
        owners = owners.distinct()  # at most `candidates` per query vector
        tokens = tokens.join(F.broadcast(owners), F.col(key).cast("string") == F.col("_key"), "left_semi")
        scored = tokens.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("source_key"), scoring.products(F.col(vector), wanted).alias("_p"))
        return top(late.sum_of_best(scored.where(F.col("_p").isNotNull()), ["source_key"], "_p", len(wanted)).join(points, "source_key"), limit, descending=True)
    rows = tokens.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("source_key"), scoring.products(F.col(vector), wanted).alias("_p"))
    rows = materialize(rows.where(F.col("_p").isNotNull()).join(points, "source_key").select("point_id", "source_key", "_p"), "tokens")
    chosen = None
    for i in range(len(wanted)):
        best = rows.select("point_id", F.get("_p", F.lit(i)).alias("s")).orderBy(F.desc("s"), "point_id").limit(candidates).select("point_id")
        chosen = best if chosen is None else chosen.unionByName(best)
    scored = late.sum_of_best(rows.join(chosen.distinct(), "point_id", "left_semi"), ["point_id", "source_key"], "_p", len(wanted))
    return top(scored, limit, descending=True)


def _has(rows: DataFrame, column: str) -> None:
    from vantor.errors import UnknownPayloadField

    if column not in rows.columns:
        raise UnknownPayloadField(f"column {column} doesn't exist")


def grouped_search(catalog: Catalog, collection: str, vector: Sequence[float], group_by: str, group_limit: int, limit: int, name: str | None = None) -> DataFrame:
    """Rows (group_value, point_id, source_key, score): the nearest group_limit points of each value of a filter key, then the first limit of all."""
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    check_limit(group_limit)
    e = catalog.vector(c, name)
    query = vectors.check_vector(vector, e.dims)
    value = catalog.compiler(c, catalog.source(c).schema).text(group_by)
    rows = _raised(project(catalog, c, _dense(e.metric, e.column, query) | {"group_value": value}, where=_there(e.column) & value.isNotNull()))
    window = Window.partitionBy("group_value").orderBy("score", "point_id")
    first = rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= group_limit)
    return top(first, limit, keep=("group_value", "point_id", "source_key", "score"))


def count(catalog: Catalog, collection: str, filter: Filter = None) -> DataFrame:
    """One row (count): active points with a source row that pass the filter."""
    c = catalog.resolve(collection)
    catalog.vector(c)
    return project(catalog, c, {}, filter).agg(F.count(F.lit(1)).alias("count"))


def facet(catalog: Catalog, collection: str, key: str, filter: Filter = None, limit: int = 100) -> DataFrame:
    """Rows (value, count) of a filter key's values as text, most frequent first, then by value; missing and null ones are left out."""
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    catalog.vector(c)
    value = catalog.compiler(c, catalog.source(c).schema).text(key)
    rows = project(catalog, c, {"value": value}, filter, where=value.isNotNull())
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def scroll(catalog: Catalog, collection: str, cursor: str | None, limit: int) -> DataFrame:
    """Rows (point_id, source_key, next_cursor): active points after the cursor in the order of their ids; each row's cursor goes on behind it."""
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    after = decode_cursor(cursor, c.collection_id) if cursor else 0
    rows = catalog.active(c).where(F.col("point_id") > after).orderBy("point_id").limit(limit)
    return rows.select("point_id", "source_key", cursor_column(c.collection_id, F.col("point_id")).alias("next_cursor"))


# The parameters of the 64-bit FNV-1a hash.
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_VERSION = "v1"


def encode_cursor(collection_id: int, after: int) -> str:
    """version:collection:position:checksum, the checksum being FNV-1a over the version and both numbers as little-endian 64-bit integers."""
    h = _FNV_START
    for b in _VERSION.encode() + collection_id.to_bytes(8, "little", signed=True) + after.to_bytes(8, "little", signed=True):
        h = (h ^ b) * _FNV_PRIME % (1 << 64)
    return f"{_VERSION}:{collection_id}:{after}:{h:016x}"


def decode_cursor(cursor: str, collection_id: int) -> int:
    parts = cursor.split(":")
    if len(parts) != 4 or parts[0] != _VERSION:
        raise InvalidParameter("malformed cursor")
    try:
        of, after = int(parts[1]), int(parts[2])
        good = encode_cursor(of, after)
    except (ValueError, OverflowError) as e:
        raise InvalidParameter("malformed cursor") from e
    if good != cursor:
        raise InvalidParameter("the cursor's checksum is wrong")
    if of != collection_id:
        raise InvalidParameter("the cursor belongs to another collection")
    return after


def cursor_column(collection_id: int, after: Column) -> Column:
    """encode_cursor of a column; a page has at most a limit's rows, so that Python's share is bounded."""
    @F.pandas_udf("string")
    def encode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: encode_cursor(collection_id, int(i)))

    return encode(after)


def _examples(catalog: Catalog, c: Collection, column: str, dims: int, *groups: Sequence[int]) -> list[list[float] | None]:
    """The mean of the vectors of each group's example points, at most a limit's number of them in all; None for an empty group."""
    ids = [(int(i), g) for g, group in enumerate(groups) for i in set(group)]
    wanted = catalog.spark.createDataFrame(ids, "point_id bigint, _g int")
    rows = project(catalog, c, {"v": F.col(f"`{column}`")}, ids=wanted).join(F.broadcast(wanted), "point_id").select("_g", "v")  # at most 10,000 rows
    means = {r["_g"]: r for r in aggregate_vectors(rows, ["_g"], "v", "avg", dims, counted="n").collect()}
    for g, group in enumerate(groups):
        if group and (g not in means or means[g]["n"] != len(set(group))):
            raise InvalidParameter("an example point doesn't exist")
    return [means[g]["value"] if group else None for g, group in enumerate(groups)]


def _check_ids(*groups: Sequence[int]) -> None:
    total = [i for g in groups for i in g]
    if any(i <= 0 for i in total):
        raise InvalidParameter("point ids are positive")
    if len(total) > 10_000:
        raise InvalidParameter("too many example points")


def _mean(values: Sequence[Sequence[float]], dims: int) -> list[float]:
    rows = [vectors.check_vector(v, dims) for v in values]
    return [sum(r[i] for r in rows) / len(rows) for i in range(dims)]


def recommend(catalog: Catalog, collection: str, positive: Sequence, negative: Sequence, limit: int, name: str | None = None) -> DataFrame:
    """The points nearest to the mean of the positive examples less that of the negative ones.

    Examples are point ids, which are then left out of the result, or vectors.
    """
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    e = catalog.vector(c, name)
    if not positive:
        raise InvalidParameter("recommend needs a positive example")
    ids = isinstance(positive[0], int)
    if ids:
        _check_ids(positive, negative)
        target, minus = _examples(catalog, c, e.column, e.dims, positive, negative)
    else:
        target, minus = _mean(positive, e.dims), _mean(negative, e.dims) if negative else None
    if minus:
        target = [a - b for a, b in zip(target, minus, strict=True)]
    rows = _raised(project(catalog, c, _dense(e.metric, e.column, target), where=_there(e.column)))
    if ids:
        rows = rows.join(_ids(catalog.spark, [*positive, *negative]), "point_id", "left_anti")
    return top(rows, limit)


def discover(catalog: Catalog, collection: str, context: Sequence[int], limit: int, name: str | None = None) -> DataFrame:
    """The points farthest from the mean of the context points, which are left out."""
    c = catalog.resolve(collection)
    catalog.enforce_search(c, limit)
    e = catalog.vector(c, name)
    if not context:
        raise InvalidParameter("discover needs a context point")
    _check_ids(context)
    (target,) = _examples(catalog, c, e.column, e.dims, context)
    rows = _raised(project(catalog, c, _dense(e.metric, e.column, target), where=_there(e.column))).join(_ids(catalog.spark, context), "point_id", "left_anti")
    return top(rows, limit, descending=True)


explore = discover


def lookup(catalog: Catalog, collection: str, point_ids: Sequence[int]) -> DataFrame:
    """The points of a list in its order: scores fall from 0 by one per place; unknown ids are dropped, and repeated ones stand at their first place."""
    c = catalog.resolve(collection)
    _check_ids(point_ids)
    places: dict[int, int] = {}
    for i, p in enumerate(point_ids):
        places.setdefault(p, i)
    wanted = catalog.spark.createDataFrame([(p, 0.0 - i) for p, i in places.items()], "point_id bigint, score double")
    rows = project(catalog, c, {}, ids=wanted).join(F.broadcast(wanted), "point_id")  # at most 10,000 rows
    return rows.select("point_id", "source_key", "score").orderBy(F.desc("score"), "point_id")
