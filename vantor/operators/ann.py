"""An approximate index: vectors in lists around centroids, kept as a versioned table, searched list by list with exact scores.

The centroids are fitted on a bounded sample; every vector is put into its nearest list. Files are sorted by list, so
that a search reads only the row groups of the lists it probes. Codes of each vector (a byte per dimension, and a bit) are columns
of their own, so that a search by codes reads no vectors but those it orders exactly. Later writes are commits of their own, read along with the
base (the delta segment); removed points are hidden by deletion vectors until compaction rewrites the files. Probing all lists gives the exact result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantor.errors import Corrupt, InvalidParameter, NotReady, UnknownTable
from vantor.functions import scoring, vectors
from vantor.runtime import drawn
from vantor.sources.catalog import check_limit
from vantor.sources.versioned import VersionedTable

#: The centroids are fitted on at most SAMPLE_PER_LIST vectors per list, of at most MAX_LISTS lists.
SAMPLE_PER_LIST, MAX_LISTS, ROUNDS, SEED = 64, 4096, 10, 17


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    if (np.diff(offsets) != dims).any():
        raise ValueError("22023: dimension mismatch")
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dims).astype(np.float64)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _direction(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if metric == "cosine" else x


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None] - 2 * (x @ centroids.T)).argmin(1)


class AnnIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path)

    @classmethod
    def build(cls, df: DataFrame, point: str, vector: str, dims: int, metric: str, path: str, lists: int | None = None, owner: str | None = None) -> AnnIndex:
        """Builds an index of all rows whose vector isn't null into a folder that has none. owner: a column of text that is kept along, such as the key of a token's point."""
        spark, self = df.sparkSession, cls(df.sparkSession, path)
        scoring.check_metric(metric)
        if self.table.version():
            raise InvalidParameter(f"{path} holds an index")
        properties = {"metric": metric, "dims": dims, "owned": owner is not None, "base_version": 1}
        rows = self._inputs(df, point, vector, owner)
        total = rows.count()
        if not total:
            raise InvalidParameter("nothing to index")
        lists = max(1, min(MAX_LISTS, lists or int(math.sqrt(total))))
        sample = drawn(rows, F.xxhash64("point_id"), lists * SAMPLE_PER_LIST, total).select("vector").collect()
        x = np.array([r[0] for r in sample], np.float64).reshape(-1, dims)
        # codes cover the sample's range with a margin; values beyond it are cut to its ends
        low, high = x.min(0), x.max(0)
        margin = np.maximum((high - low) * 0.05, 1e-6)
        x = np.unique(_direction(x, metric), axis=0)  # copies would take up lists of their own, all at one place
        centroids = x[np.random.default_rng(SEED).permutation(len(x))[:lists]].copy()
        for _ in range(ROUNDS):
            near = _nearest(x, centroids)
            held = np.bincount(near, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, x)
            centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
        centroids = np.unique(np.round(centroids, 7), axis=0)
        properties |= {"centroids": centroids.tolist(), "low": np.round(low - margin, 6).tolist(), "high": np.round(high + margin, 6).tolist(), "base_rows": total}
        properties["checksum"] = _checksum(properties)
        self.table.commit(self._assigned(rows, properties), properties=properties)
        return self

    @staticmethod
    def _inputs(df: DataFrame, point: str, vector: str, owner: str | None) -> DataFrame:
        kept = F.lit(None).cast("string") if owner is None else F.col(owner).cast("string")
        return df.where(F.col(vector).isNotNull()).select(F.col(point).cast("bigint").alias("point_id"), kept.alias("owner"), F.col(vector).cast("array<float>").alias("vector"))

    def _properties(self) -> dict:
        if not self.table.version():
            raise NotReady(f"no index at {self.table.path}")
        p = self.table.manifest().properties
        if p.get("checksum") != _checksum(p):
            raise Corrupt("the index's centroids don't match their checksum")
        return p

    @staticmethod
    def _assigned(rows: DataFrame, p: dict) -> DataFrame:
        """rows with their list and codes, those of a list together; eight tasks share a list, so that none has to hold a crowded one."""
        dims, metric, centroids, low, high = p["dims"], p["metric"], *(np.array(p[n]) for n in ("centroids", "low", "high"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    x = _rows(part.column(2), dims)
                    near = _nearest(_direction(x, metric), centroids).astype(np.int32)
                    scale = np.clip(np.rint((x - low) / (high - low) * 255), 0, 255).astype(np.uint8)
                    bits = np.packbits(x >= 0, axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near), _bytes(scale), _bytes(bits)], ["point_id", "owner", "vector", "list", "scalar_code", "binary_code"])

        out = rows.mapInArrow(assign, "point_id bigint, owner string, vector array<float>, list int, scalar_code binary, binary_code binary")
        return out.repartition(F.col("list"), F.pmod(F.xxhash64("point_id"), F.lit(8))).sortWithinPartitions("list", "point_id")

    def add(self, df: DataFrame, point: str, vector: str, owner: str | None = None) -> int:
        """Adds rows, replacing points that are there; returns the new version."""
        p = self._properties()
        rows = self._inputs(df, point, vector, owner)
        self.remove(rows.select("point_id"))
        return self.table.commit(self._assigned(rows, p))

    def remove(self, points: DataFrame) -> int:
        """Hides points; returns the version. The ids are matched by a join, hence of any number."""
        ids = points.select(F.col(points.columns[0]).cast("bigint").alias("point_id")).distinct()
        return self.table.commit(delete_keys=ids)

    def compact(self) -> dict:
        """Rewrites all visible rows as the base; returns counts (live_rows, base_records_read, delta_records_drained)."""
        p, before = self._properties(), self.table.manifest()
        live = self.table.read().select("point_id", "owner", "vector")
        total = live.count()
        self.table.replace(self._assigned(live, p), base=before.version, properties={"base_rows": total, "base_version": before.version + 1})
        return {"live_rows": total, "base_records_read": p["base_rows"], "delta_records_drained": max(0, total - p["base_rows"])}

    def probed(self, vector: Sequence[float], probes: int) -> list[int]:
        """The lists nearest to a query vector."""
        p = self._properties()
        c = np.array(p["centroids"])
        q = _direction(np.array([vectors.check_vector(vector, p["dims"])]), p["metric"])
        near = -(c @ q[0]) if p["metric"] == "inner_product" else (c**2).sum(1) - 2 * (c @ q[0])
        return np.argsort(near, kind="stable")[: max(1, probes)].tolist()

    def _probed_rows(self, queries: Sequence[Sequence[float]], probes: int, allowed: DataFrame | None, columns: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
        """The rows (list, columns) of all lists that some query probes, and which query probes which list."""
        p = self._properties()
        by_query = np.zeros((len(queries), len(p["centroids"])), bool)
        for i, q in enumerate(queries):
            by_query[i, self.probed(q, probes)] = True
        rows = self.table.read()
        if not by_query.any(0).all():
            rows = rows.where(F.col("list").isin(np.nonzero(by_query.any(0))[0].tolist()))  # at most MAX_LISTS numbers
        if allowed is not None:
            rows = rows.join(allowed.select(F.col(allowed.columns[0]).cast("bigint").alias("point_id")), "point_id", "left_semi")
        return rows.select("list", *columns), by_query

    def scan(self, queries: Sequence[Sequence[float]], probes: int = 8, allowed: DataFrame | None = None, keep: int | None = None, how: str = "exact") -> DataFrame:
        """Rows (query, point_id, owner, score) of the probed lists, query being the place in the list of queries; all queries go through one pass.

        keep: how many of each query a batch passes on (all by default). how: exact scores from the vectors, or those of the "scalar" or
        "binary" codes, of which binary ones are bits that differ.
        """
        p = self._properties()
        if how not in ("exact", "scalar", "binary"):
            raise InvalidParameter("how must be exact, scalar or binary")
        dims, metric, low, high = p["dims"], p["metric"], np.array(p["low"]), np.array(p["high"])
        q = np.array([vectors.check_vector(x, dims) for x in queries])
        column = {"exact": "vector", "scalar": "scalar_code", "binary": "binary_code"}[how]
        rows, by_query = self._probed_rows(queries, probes, allowed, ["point_id", "owner", column])
        signs = np.packbits(q >= 0, axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    lists, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                    x = _rows(part.column(3), dims) if how == "exact" else np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
                    x = low + x * ((high - low) / 255) if how == "scalar" else x
                    for i in range(len(q)):
                        mine = np.nonzero(by_query[i][lists])[0]
                        if not len(mine):
                            continue
                        s = np.bitwise_count(x[mine] ^ signs[i]).sum(1).astype(float) if how == "binary" else scoring.scores_of(metric, x[mine], q[i])
                        if keep is not None and len(mine) > keep:
                            first = np.lexsort((ids[mine], s))[:keep]
                            mine, s = mine[first], s[first]
                        taken = part.take(pa.array(mine))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), i, np.int32)), taken.column(1), taken.column(2), pa.array(s)], ["query", "point_id", "owner", "score"])

        return rows.mapInArrow(run, "query int, point_id bigint, owner string, score double")

    def search_many(self, queries: Sequence[Sequence[float]], limit: int, probes: int = 8, allowed: DataFrame | None = None, how: str = "exact", candidates: int | None = None) -> DataFrame:
        """Rows (query, point_id, owner, score): the first `limit` of each query, nearest first, then point_id.

        With codes (how "scalar" or "binary"), they choose `candidates` points of each query, whose vectors are then read and scored exactly.
        """
        check_limit(limit)
        order = Window.partitionBy("query").orderBy("score", "point_id")
        first = lambda df, n: df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
        if how == "exact":
            return first(self.scan(queries, probes, allowed, limit), limit)
        wanted = max(limit, candidates or 10 * limit)
        check_limit(wanted)
        p = self._properties()
        dims, metric = p["dims"], p["metric"]
        chosen = first(self.scan(queries, probes, allowed, wanted, how), wanted).select("query", "point_id")
        rows, _ = self._probed_rows(queries, probes, None, ["point_id", "owner", "vector"])
        q = np.array([vectors.check_vector(x, dims) for x in queries])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    of, x = batch.column(0).to_numpy(), _rows(batch.column(3), dims)
                    s = np.empty(len(of))
                    for i in np.unique(of):
                        s[of == i] = scoring.scores_of(metric, x[of == i], q[i])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s)], ["query", "point_id", "owner", "score"])

        pairs = rows.join(F.broadcast(chosen), "point_id").select("query", "point_id", "owner", "vector")  # `wanted` ids of each query
        return first(pairs.mapInArrow(run, "query int, point_id bigint, owner string, score double"), limit)

    def search(self, vector: Sequence[float], limit: int, probes: int = 8, allowed: DataFrame | None = None) -> DataFrame:
        """Rows (point_id, score), nearest first among the probed lists; allowed restricts the points, as a table of ids of any size."""
        check_limit(limit)
        return self.scan([vector], probes, allowed, limit).select("point_id", "score").orderBy("score", "point_id").limit(limit)

    def search_quantized(self, vector: Sequence[float], limit: int, candidates: int, how: str = "scalar", probes: int = 8) -> DataFrame:
        """As search, but the stored codes choose `candidates` points in the probed lists, which the exact distance then orders."""
        if how not in ("scalar", "binary"):
            raise InvalidParameter("how must be scalar or binary")
        return self.search_many([vector], limit, probes, None, how, candidates).select("point_id", "score").orderBy("score", "point_id").limit(limit)

    def status(self) -> DataFrame:
        """One row (status, detail, repair_advice): ready, not_ready or corrupt."""
        try:
            p = self._properties()
            row = ("ready", f"{p['base_rows']} rows in {len(p['centroids'])} lists", "none")
        except NotReady as e:
            row = ("index_not_ready", str(e), "build the index")
        except (Corrupt, UnknownTable) as e:
            row = ("index_corrupt", str(e), "rebuild the index")
        return self.spark.createDataFrame([row], "status string, detail string, repair_advice string")

    def memory(self) -> DataFrame:
        """One row (estimated_rows, dimensions, vector_bytes, code_bytes, centroid_bytes, lists)."""
        p = self._properties()
        rows = self.table.read().count()
        row = (rows, p["dims"], rows * p["dims"] * 4, rows * (p["dims"] + (p["dims"] + 7) // 8), len(p["centroids"]) * p["dims"] * 8, len(p["centroids"]))
        return self.spark.createDataFrame([row], "estimated_rows bigint, dimensions int, vector_bytes bigint, code_bytes bigint, centroid_bytes bigint, lists int")

    def advice(self, share: float = 0.2) -> DataFrame:
        """One row (live_rows, base_rows, hidden_files, status): compaction_recommended once the delta or the files with hidden rows pass a share."""
        p, m = self._properties(), self.table.manifest()
        rows, hidden = self.table.read().count(), sum(v is not None for v in m.files.values())
        due = abs(rows - p["base_rows"]) > share * max(1, p["base_rows"]) or hidden > share * max(1, len(m.files))
        return self.spark.createDataFrame([(rows, p["base_rows"], hidden, "compaction_recommended" if due else "healthy")], "live_rows bigint, base_rows bigint, hidden_files bigint, status string")


def _checksum(p: dict) -> int:
    return zlib.crc32(np.array(p["centroids"], np.float64).tobytes() + f"{p['metric']}/{p['dims']}".encode())
