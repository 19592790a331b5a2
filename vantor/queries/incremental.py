"""Queries over the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.operators import incremental
from vantor.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_points(table(spark, d, "collection_points"), table(spark, d, "build_jobs"))


def p4_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = incremental.record_deltas(table(spark, d, "collection_points"), table(spark, d, "build_jobs"))
    rows = rows.withColumn("unread", F.col("reason") == "unread")
    return rows.groupBy("collection_id", "unread").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("point_id").alias("n_points"))


_RUNS = """runs AS (SELECT collection_id, snapshot_at, checkpoint_at, last_source_point_id FROM build_jobs WHERE status = 'completed'
  AND collection_id IS NOT NULL AND snapshot_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY snapshot_at DESC, checkpoint_at DESC NULLS LAST, last_source_point_id DESC NULLS LAST) = 1)"""
_BEHIND = "(t > checkpoint_at OR (t = checkpoint_at AND point_id > last_source_point_id))"

QUERIES = {"p4_found": p4_found, "p4_deltas": p4_deltas}
SQL = {
    "p4_found": f"""WITH {_RUNS}, v AS (SELECT point_id, collection_id, greatest(created_at, updated_at, deleted_at) AS t, min(loaded_at) AS loaded
        FROM collection_points WHERE point_id IS NOT NULL GROUP BY 1, 2, 3),
      present AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY point_id, collection_id ORDER BY t DESC NULLS LAST) = 1)
      SELECT DISTINCT point_id FROM present LEFT JOIN runs USING (collection_id)
      WHERE snapshot_at IS NULL OR loaded IS NULL OR loaded > snapshot_at OR {_BEHIND}""",
    "p4_deltas": f"""WITH {_RUNS}, r AS (SELECT p.*, greatest(created_at, updated_at, deleted_at) AS t, snapshot_at, checkpoint_at, last_source_point_id
        FROM (SELECT point_id, collection_id, created_at, updated_at, deleted_at, loaded_at FROM collection_points) p LEFT JOIN runs USING (collection_id))
      SELECT collection_id, unread, count(*) AS n_rows, count(DISTINCT point_id) AS n_points FROM (
        SELECT collection_id, point_id, NOT (snapshot_at IS NULL OR loaded_at IS NULL OR loaded_at > snapshot_at) AS unread FROM r
        WHERE snapshot_at IS NULL OR loaded_at IS NULL OR loaded_at > snapshot_at OR {_BEHIND}) GROUP BY 1, 2""",
}
