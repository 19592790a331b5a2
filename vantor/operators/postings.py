"""An index of sparse vectors by their terms: one row per entry, sorted by term, kept as a versioned table.

A search reads only the terms of the query, adds up their products by point, and orders by scores that are exact: a
vector's squared length is kept with each entry, so that the inner product is all that L2 and cosine need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.errors import InvalidParameter, NotReady, UnsupportedMetric
from vantor.functions import sparse
from vantor.runtime import materialize
from vantor.sources.catalog import check_limit
from vantor.sources.versioned import VersionedTable


class SparseIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path)

    @classmethod
    def build(cls, df: DataFrame, point: str, vector: str, dims: int, metric: str, path: str) -> SparseIndex:
        """Builds an index of all rows whose vector isn't null and has entries, into a folder that has none. Under l1 there is none."""
        if metric not in ("inner_product", "l2", "cosine"):
            raise UnsupportedMetric(f"{metric} can't be served from terms")
        self = cls(df.sparkSession, path)
        if self.table.version():
            raise InvalidParameter(f"{path} holds an index")
        self.table.commit(self._entries(df, point, vector, dims), properties={"metric": metric, "dims": dims})
        return self

    @staticmethod
    def _entries(df: DataFrame, point: str, vector: str, dims: int) -> DataFrame:
        v = F.col("_v")
        rows = df.where(F.col(vector).isNotNull()).select(F.col(point).cast("bigint").alias("point_id"), F.col(vector).alias("_v"))
        good = F.when(v["dims"] == dims, v["values"]).otherwise(F.raise_error(F.lit("22023: dimension mismatch")).cast("array<float>"))
        norm = F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        out = rows.select("point_id", norm.alias("norm2"), F.explode(F.arrays_zip(v["indices"].alias("term"), good.alias("value"))).alias("e"))
        # the salt lets several tasks share a term that many vectors have
        out = out.select("point_id", "norm2", F.col("e.term").alias("term"), F.col("e.value").cast("double").alias("value"))
        return out.repartition(F.col("term"), F.pmod(F.xxhash64("point_id"), F.lit(8))).sortWithinPartitions("term", "point_id")

    def add(self, df: DataFrame, point: str, vector: str) -> int:
        """Adds rows, replacing points that are there; returns the new version."""
        p = self._properties()
        rows = materialize(df.select(F.col(point).cast("bigint").alias("point_id"), F.col(vector).alias("v")), "sparse")
        self.remove(rows)
        return self.table.commit(self._entries(rows, "point_id", "v", p["dims"]))

    def remove(self, points: DataFrame) -> int:
        """Hides points; returns the version."""
        return self.table.commit(delete_keys=points.select(F.col(points.columns[0]).cast("bigint").alias("point_id")).distinct())

    def _properties(self) -> dict:
        if not self.table.version():
            raise NotReady(f"no index at {self.table.path}")
        return self.table.manifest().properties

    def candidates(self, query: sparse.Sparse | str, limit: int, terms: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """Rows (point_id, score), best first, of points that share a term with the query; lower scores are better.

        terms: only so many of the query's terms, those of the largest values, are read; the scores are then approximate. allowed: a
        table of the ids that may be returned, of any size.
        """
        check_limit(limit)
        p, q = self._properties(), sparse.literal(query)
        if q.dims != p["dims"]:
            raise InvalidParameter(f"expected {p['dims']} dimensions, not {q.dims}")
        heavy = sorted(zip(q.indices, q.values, strict=True), key=lambda e: (-abs(e[1]), e[0]))[:terms]
        if not heavy:
            raise InvalidParameter("the query has no terms")
        weights = self.spark.createDataFrame([(int(i), float(x)) for i, x in heavy], "term int, _w double")
        rows = self.table.read().where(F.col("term").isin([int(i) for i, _ in heavy])).join(F.broadcast(weights), "term")  # the query's terms
        if allowed is not None:
            rows = rows.join(allowed.select(F.col(allowed.columns[0]).cast("bigint").alias("point_id")), "point_id", "left_semi")
        sums = rows.groupBy("point_id").agg(F.sum(F.col("value") * F.col("_w")).alias("_ip"), F.max("norm2").alias("_n"))
        length2 = sum(x * x for x in q.values)
        score = {"inner_product": -F.col("_ip"), "cosine": 1.0 - F.col("_ip") / F.sqrt(F.col("_n") * length2), "l2": F.sqrt(F.greatest(F.lit(0.0), F.col("_n") + length2 - 2 * F.col("_ip")))}
        return sums.select("point_id", score[p["metric"]].alias("score")).orderBy("score", "point_id").limit(limit)
