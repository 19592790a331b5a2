"""Operational reports: recall checks, query statistics, telemetry, optimization status, advice, index comparison."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter
from vantor.sources.catalog import Catalog

STATS = (
    "collection_name string, cohort string, query_kind string, strategy string, lifecycle_state string, result_count bigint, visits bigint, filter_candidates bigint, "
    "candidates_considered bigint, rows_rechecked bigint, rows_pruned bigint, recall_threshold double, recall_achieved double, latency_ms double, recorded_at timestamp"
)


def recall_check(spark: SparkSession, exact: Sequence[int], candidates: Sequence[int], least: float) -> DataFrame:
    """One row (exact_count, candidate_count, intersection_count, recall, status) over distinct ids; without exact ids recall is 1 and status empty_exact."""
    if not (math.isfinite(least) and 0 <= least <= 1):
        raise InvalidParameter("a recall is 0 to 1")
    if len(exact) > 10_000 or len(candidates) > 10_000:
        raise InvalidParameter("too many ids")
    a, b = set(exact), set(candidates)
    both = len(a & b)
    recall = both / len(a) if a else 1.0
    status = "empty_exact" if not a else "passing" if recall >= least else "failing"
    return spark.createDataFrame([(len(a), len(b), both, recall, status)], "exact_count bigint, candidate_count bigint, intersection_count bigint, recall double, status string")


def recall_by_query(exact: DataFrame, candidates: DataFrame, query: str, item: str) -> DataFrame:
    """Rows (query, exact_count, candidate_count, intersection_count, recall) for two tables of (query, item), each any size."""
    a, b = (df.select(query, item).distinct().withColumn(name, F.lit(1)) for df, name in ((exact, "_a"), (candidates, "_b")))
    both = a.join(b, [query, item], "full")
    out = both.groupBy(query).agg(F.count("_a").alias("exact_count"), F.count("_b").alias("candidate_count"), F.count(F.col("_a") * F.col("_b")).alias("intersection_count"))
    return out.withColumn("recall", F.when(F.col("exact_count") == 0, 1.0).otherwise(F.col("intersection_count") / F.nullif(F.col("exact_count"), F.lit(0))))


def record_query_stat(
    spark: SparkSession, path: str, collection: str, cohort: str, query_kind: str, result_count: int, candidates: int, latency_ms: float | None = None, *, strategy: str = "exact",
    lifecycle: str = "exact", visits: int = 0, filter_candidates: int = 0, rechecked: int = 0, pruned: int = 0, threshold: float | None = None, achieved: float | None = None,
) -> bool:
    """Appends a row to the table of query statistics; counts must not be negative, recalls are 0 to 1."""
    import datetime

    if min(result_count, candidates, visits, filter_candidates, rechecked, pruned) < 0 or (latency_ms is not None and not latency_ms >= 0):
        raise InvalidParameter("counts and latency must not be negative")
    if any(x is not None and not 0 <= x <= 1 for x in (threshold, achieved)):
        raise InvalidParameter("a recall is 0 to 1")
    row = (collection, cohort, query_kind, strategy, lifecycle, result_count, visits, filter_candidates, candidates, rechecked, pruned, threshold, achieved, latency_ms, datetime.datetime.now())
    spark.createDataFrame([row], STATS).write.mode("append").parquet(path)
    return True


def latency_bucket(latency: Column) -> Column:
    return F.when(latency < 1, "lt_1ms").when(latency < 10, "lt_10ms").when(latency < 100, "lt_100ms").when(latency < 1000, "lt_1s").when(latency >= 1000, "gte_1s").otherwise("unspecified")


def query_cohort_stats(stats: DataFrame) -> DataFrame:
    """Per collection, cohort and kind: number of queries, totals, average recall and latency."""
    return stats.groupBy("collection_name", "cohort", "query_kind").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("result_count").alias("total_results"), F.sum("candidates_considered").alias("total_candidates"),
        F.sum("rows_rechecked").alias("total_rows_rechecked"), F.sum("rows_pruned").alias("total_rows_pruned"), F.avg("recall_achieved").alias("avg_recall_achieved"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.lit("observed").alias("status"),
    )


def query_execution_stats(stats: DataFrame) -> DataFrame:
    """Per collection, kind, strategy and latency bucket: number of queries and totals of work."""
    return stats.groupBy("collection_name", "query_kind", "strategy", latency_bucket(F.col("latency_ms")).alias("latency_bucket")).agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("visits").alias("total_visits"), F.sum("filter_candidates").alias("total_filter_candidates"),
        F.sum("candidates_considered").alias("total_candidates"), F.sum("rows_rechecked").alias("total_rechecks"), F.avg("latency_ms").alias("avg_latency_ms"),
    )


def _point_counts(catalog: Catalog) -> DataFrame:
    parts = [p.select(F.lit(cid).cast("bigint").alias("collection_id"), "deleted_at") for cid, p in catalog.points.items()]
    if not parts:
        return catalog.spark.createDataFrame([], "collection_id bigint, active_points bigint, deleted_points bigint")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("collection_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("active_points"), F.count("deleted_at").alias("deleted_points"))


def telemetry(catalog: Catalog) -> DataFrame:
    """One row per collection: what is registered, points by state, and a status.

    missing_artifacts: no table or no vector; stale_catalog: the table is gone; empty: no active point; else active.
    """
    base = catalog.spark.createDataFrame(
        [(c.collection_id, c.name, c.table, c.table is not None, c.table in catalog.tables, len(c.vectors) + len(c.sparse), len(c.fields)) for c in catalog.collections.values()],
        "collection_id bigint, collection_name string, table_name string, has_source_table boolean, source_table_exists boolean, registered_vectors bigint, filter_fields bigint",
    )
    rows = base.join(_point_counts(catalog), "collection_id", "left").fillna(0, ["active_points", "deleted_points"])
    status = (
        F.when(~F.col("has_source_table") | (F.col("registered_vectors") == 0), "missing_artifacts").when(~F.col("source_table_exists"), "stale_catalog")
        .when(F.col("active_points") == 0, "empty").otherwise("active")
    )
    return rows.withColumn("status", status).drop("collection_id")


def optimization_status(catalog: Catalog, collection: str) -> DataFrame:
    """One row with a status: missing_artifacts, stale_catalog, indexed or exact_only."""
    c = catalog.resolve(collection)
    entries = [*c.vectors.values(), *c.sparse.values()]
    indexes = sum(e.index is not None for e in entries)
    if c.table is None or not entries:
        status = "missing_artifacts"
    elif c.table not in catalog.tables:
        status = "stale_catalog"
    else:
        status = "indexed" if indexes else "exact_only"
    row = (c.name, c.table, c.table is not None, c.table in catalog.tables, len(entries), catalog.active(c).count(), len(c.fields), indexes, status)
    return catalog.spark.createDataFrame([row], "collection_name string, table_name string, has_source_table boolean, source_table_exists boolean, registered_vectors bigint, active_points bigint, filter_fields bigint, indexes bigint, status string")


def index_advisor(catalog: Catalog, collection: str) -> DataFrame:
    """Advice rows (collection_name, filter_key, column_name, recommendation, detail): layout hints in place of database indexes.

    Filter columns: sort or partition the files by them; JSON paths: extract them into columns; vectors without an index: build one; otherwise no_action.
    """
    c = catalog.exact(collection)
    rows = []
    for key, f in sorted(c.fields.items()):
        if f.path is None:
            rows.append((c.name, key, f.column, "cluster_files", f"sort or partition the files by {f.column} so that filters skip files"))
        else:
            rows.append((c.name, key, f.column, "extract_column", f"keep {'.'.join(f.path)} as a column of its own so that filters reach the scan"))
    for e in sorted(c.vectors.values(), key=lambda e: e.name):
        if e.index is None:
            rows.append((c.name, None, e.column, "build_index", f"build an index over {e.column} for searches that may be approximate"))
    return catalog.spark.createDataFrame(rows or [(c.name, None, None, "no_action", "nothing to do")], "collection_name string, filter_key string, column_name string, recommendation string, detail string")


def compare_indexes(spark: SparkSession, ways: Mapping[str, Callable[[Sequence[float]], DataFrame]], exact: Callable[[Sequence[float]], DataFrame], queries: Sequence[Sequence[float]]) -> DataFrame:
    """Rows (index_name, p50_ms, p95_ms, recall_at_10): each way's times and recall against the exact search for sample queries."""
    if not queries:
        raise InvalidParameter("no queries")
    rows, truth = [], [{r[0] for r in exact(q).select("point_id").limit(10).collect()} for q in queries]
    for name, way in ways.items():
        times, hits, total = [], 0, 0
        for q, want in zip(queries, truth, strict=True):
            began = time.perf_counter()
            got = {r[0] for r in way(q).select("point_id").limit(10).collect()}
            times.append((time.perf_counter() - began) * 1000)
            hits, total = hits + len(got & want), total + len(want)
        times.sort()
        rows.append((name, times[len(times) // 2], times[min(len(times) - 1, int(len(times) * 0.95))], hits / total if total else 1.0))
    return spark.createDataFrame(rows, "index_name string, p50_ms double, p95_ms double, recall_at_10 double")
