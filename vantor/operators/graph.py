"""A layered proximity graph per shard: navigable small worlds, built and searched by the executors.

Rows are dealt into shards of bounded size by a hash of their id. Each shard's graph is built in one task and kept as one
checksummed row of a versioned table. A search walks every shard's graph (greedy through the upper layers, a beam at the
base) and merges the shards' results. Later rows form shards of their own; removed ids are tombstones, which still
route; compaction builds anew. Exact search needs none of this; recall depends on the beam's width.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantor.errors import Corrupt, InvalidParameter, NotReady
from vantor.functions import scoring, vectors
from vantor.sources.catalog import check_limit
from vantor.sources.jobs import decode_segment, encode_segment
from vantor.sources.versioned import VersionedTable

SHARD_ROWS, SEED = 20_000, 23


def node_level(node: int, m: int) -> int:
    """Layers above the base by the published law: floor(-ln(u) / ln(m)) for a u that is uniform in (0, 1), here out of a hash of the node's number."""
    bits = int.from_bytes(hashlib.blake2b(f"{SEED}/{node}".encode(), digest_size=8).digest(), "little") >> 11
    return min(16, int(-math.log((bits + 0.5) / (1 << 53)) / math.log(m)))


class ShardGraph:
    """The graph over one shard's vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, metric: str, m: int = 16, of: np.ndarray | None = None) -> None:
        """rows are the nodes' vectors; of tells the node of each id, as equal vectors share one (by default each id has its own)."""
        self.ids, self.metric, self.m = ids, metric, m
        self.of = np.arange(len(ids)) if of is None else of
        self.rows = rows.astype(np.float32)
        if metric == "cosine":
            self.rows = self.rows / np.maximum(np.linalg.norm(self.rows, axis=1, keepdims=True), 1e-30)
        self.links: list[dict[int, np.ndarray]] = []
        self.entry = -1

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        x = self.rows[nodes]
        if self.metric in ("cosine", "inner_product"):
            return -(x @ q)
        return np.abs(x - q).sum(1) if self.metric == "l1" else ((x - q) ** 2).sum(1)

    def build(self, ef: int = 64) -> ShardGraph:
        for node in range(len(self.rows)):
            self._insert(node, ef)
        return self

    def _insert(self, node: int, ef: int) -> None:
        level, q = node_level(node, self.m), self.rows[node]
        top = len(self.links) - 1
        start = self.entry
        for layer in range(top, level, -1):
            start = self._greedy(q, start, layer)
        near = [] if start < 0 else [(float(self._far(q, np.array([start]))[0]), start)]
        for layer in range(min(level, top), -1, -1):
            near = self._beam(q, [n for _, n in near], layer, ef)
            chosen = self._diverse(near, self.m)
            self.links[layer][node] = np.array(chosen, np.int32)
            most = self.m * (2 if layer == 0 else 1)
            for other in chosen:
                have = np.append(self.links[layer][other], np.int32(node))
                if len(have) > most:
                    far = self._far(self.rows[other], have)
                    have = np.array(self._diverse(sorted(zip(far.tolist(), have.tolist(), strict=True)), most), np.int32)
                self.links[layer][other] = have
        for _ in range(top + 1, level + 1):
            self.links.append({node: np.zeros(0, np.int32)})
            self.entry = node

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """The nearest candidates that are nearer to the node than to one chosen before; the rest fills up."""
        chosen: list[int] = []
        rest: list[int] = []
        for far, n in near:
            if len(chosen) >= most:
                break
            if chosen and (self._far(self.rows[n], np.array(chosen)) < far).any():
                rest.append(n)
            else:
                chosen.append(n)
        return chosen + rest[: most - len(chosen)]

    def _greedy(self, q: np.ndarray, start: int, layer: int) -> int:
        best = float(self._far(q, np.array([start]))[0])
        while True:
            around = self.links[layer][start]
            if not len(around):
                return start
            far = self._far(q, around)
            i = int(far.argmin())
            if far[i] >= best:
                return start
            best, start = float(far[i]), int(around[i])

    def _beam(self, q: np.ndarray, starts: Sequence[int], layer: int, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The nearest nodes found, nearest first; with a mask only allowed ones, though the others route. If few are allowed, the walk also looks two steps ahead."""
        seen = np.zeros(len(self.rows), bool)
        first = np.unique(np.array(starts, np.int64))
        seen[first] = True
        far = self._far(q, first)
        todo = [(float(d), int(n)) for d, n in zip(far, first, strict=True)]
        heapq.heapify(todo)
        found = [(-d, -n) for d, n in todo if allowed is None or allowed[n]]
        heapq.heapify(found)
        wide = allowed is not None and int(allowed.sum()) * 4 < len(allowed)
        while todo:
            d, n = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            around = self.links[layer].get(n, np.zeros(0, np.int32))
            if wide and len(around):
                around = np.unique(np.concatenate([around, *(self.links[layer].get(int(a), np.zeros(0, np.int32)) for a in around)]))
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            for e, a in zip(self._far(q, around).tolist(), around.tolist(), strict=True):
                if len(found) < ef or e < -found[0][0]:
                    heapq.heappush(todo, (e, a))
                    if allowed is None or allowed[a]:
                        heapq.heappush(found, (-e, -a))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, -n) for d, n in found)

    def search(self, q: np.ndarray, ef: int, allowed: np.ndarray | None = None, each: int | None = None) -> list[int]:
        """Places (in ids) of the nearest rows found by a beam of that width; of equal vectors the `each` smallest ids. allowed: a mask of ids."""
        if self.entry < 0:
            return []
        nodes = self._nodes(q, ef, None if allowed is None else np.bincount(self.of, allowed, len(self.rows)) > 0)
        order = np.lexsort((self.ids, self.of))
        begin = np.searchsorted(self.of[order], nodes)
        end = np.searchsorted(self.of[order], nodes, side="right")
        out = []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = order[a:b] if allowed is None else order[a:b][allowed[order[a:b]]]
            out += own[:each].tolist()
        return out

    def _nodes(self, q: np.ndarray, ef: int, allowed: np.ndarray | None) -> list[int]:
        q = q.astype(np.float32)
        if self.metric == "cosine":
            q = q / max(float(np.linalg.norm(q)), 1e-30)
        start = self.entry
        for layer in range(len(self.links) - 1, 0, -1):
            start = self._greedy(q, start, layer)
        return [n for _, n in self._beam(q, [start], 0, ef, allowed)]

    def dump(self, original: np.ndarray) -> bytes:
        """The graph with the vectors as they came, as a checksummed segment."""
        nodes = [np.fromiter(layer, np.int32, len(layer)) for layer in self.links]
        flat = {f"n{i}": n for i, n in enumerate(nodes)}
        flat |= {f"c{i}": np.array([len(layer[int(n)]) for n in nodes[i]], np.int32) for i, layer in enumerate(self.links)}
        flat |= {f"l{i}": np.concatenate([layer[int(n)] for n in nodes[i]] or [np.zeros(0, np.int32)]) for i, layer in enumerate(self.links)}
        out = io.BytesIO()
        np.savez(out, ids=self.ids, of=self.of, rows=original.astype(np.float32), meta=np.array([self.m, self.entry, len(self.links)]), **flat)
        return encode_segment("graph", out.getvalue())

    @classmethod
    def load(cls, segment: bytes, metric: str) -> tuple[ShardGraph, np.ndarray]:
        """(graph, vectors as they came); a damaged segment, or links out of range, are an error."""
        kind, payload = decode_segment(segment)
        if kind != "graph":
            raise Corrupt("not a graph segment")
        with np.load(io.BytesIO(payload), allow_pickle=False) as data:
            m, entry, layers = (int(x) for x in data["meta"])
            self = cls(data["ids"], data["rows"], metric, m, data["of"])
            self.entry = entry
            for i in range(layers):
                links = data[f"l{i}"]
                if len(links) and not 0 <= links.min() <= links.max() < len(self.rows):
                    raise Corrupt("link out of range")
                self.links.append(dict(zip(data[f"n{i}"].tolist(), np.split(links, np.cumsum(data[f"c{i}"])[:-1]), strict=True)))
            return self, data["rows"]


class GraphIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table, self.gone = spark, VersionedTable(spark, f"{path}/shards"), VersionedTable(spark, f"{path}/removed")

    @classmethod
    def build(cls, df: DataFrame, point: str, vector: str, dims: int, metric: str, path: str, m: int = 16, ef_construction: int = 64, shard_rows: int = SHARD_ROWS) -> GraphIndex:
        """Builds an index of all rows whose vector isn't null; ids must be unique."""
        scoring.check_metric(metric)
        if not 2 <= m <= 100 or ef_construction < m or shard_rows < 1:
            raise InvalidParameter("bad graph parameters")
        self = cls(df.sparkSession, path)
        if self.table.version():
            raise InvalidParameter(f"{path} holds an index")
        properties = {"metric": metric, "dims": dims, "m": m, "ef_construction": ef_construction, "shard_rows": shard_rows}
        self.table.commit(self._built(df, point, vector, properties), properties=properties)
        rows = self.table.read().agg({"n": "sum"}).first()[0] or 0
        self.table.commit(properties={"base_rows": int(rows)})
        return self

    def _properties(self) -> dict:
        if not self.table.version():
            raise NotReady("no index")
        return self.table.manifest().properties

    @staticmethod
    def _built(df: DataFrame, point: str, vector: str, p: dict) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull()).select(F.col(point).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        shards = max(1, math.ceil(rows.count() / p["shard_rows"]))
        dims, metric, m, ef = p["dims"], p["metric"], p["m"], p["ef_construction"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = [b for b in batches if b.num_rows]
            if not whole:
                return
            data = pa.Table.from_batches(whole).sort_by("id")
            column = data["v"].combine_chunks()
            if (np.diff(column.offsets.to_numpy()) != dims).any():
                raise ValueError("22023: dimension mismatch")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids = data["id"].to_numpy()
            _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
            place = np.argsort(np.argsort(first))  # nodes in the order of their first ids
            nodes = x[np.sort(first)]
            graph = ShardGraph(ids, nodes, metric, m, place[of.ravel()]).build(ef)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([graph.dump(nodes)], pa.binary()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["n", "segment", "ids"])

        part = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
        return rows.repartitionById(shards, part).mapInArrow(run, "n bigint, segment binary, ids array<bigint>")

    def add(self, df: DataFrame, point: str, vector: str) -> int:
        """Adds rows as shards of their own (the delta); ids must be new."""
        return self.table.commit(self._built(df, point, vector, self._properties()))

    def remove(self, points: DataFrame) -> int:
        """Marks ids as removed; their nodes go on to route."""
        self._properties()
        return self.gone.commit(points.select(F.col(points.columns[0]).cast("bigint").alias("point_id")).distinct())

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.gone.read(), "point_id", "left_anti") if self.gone.version() else rows

    def rows(self) -> DataFrame:
        """Rows (point_id, vector) out of the shards, without removed ones."""
        metric = self._properties()["metric"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for segment in batch.column(0).to_pylist():
                    graph, x = ShardGraph.load(segment, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(graph.ids), pa.array(list(x[graph.of]), pa.list_(pa.float32()))], ["point_id", "vector"])

        return self._live(self.table.read().select("segment").mapInArrow(run, "point_id bigint, vector array<float>"))

    def compact(self) -> int:
        """Builds all shards anew from the live rows; returns the version."""
        p = self._properties()
        version = self.table.replace(self._built(self.rows(), "point_id", "vector", p))
        if self.gone.version():
            self.gone.replace(self.spark.createDataFrame([], "point_id bigint"))
        return version

    def search(self, vector: Sequence[float], limit: int, ef: int = 64, allowed: DataFrame | None = None) -> DataFrame:
        """Rows (point_id, score), nearest first, scored exactly in double precision. See search_many."""
        return self.search_many([vector], limit, ef, allowed).select("point_id", "score").orderBy("score", "point_id").limit(limit)

    def search_many(self, queries: Sequence[Sequence[float]], limit: int, ef: int = 64, allowed: DataFrame | None = None) -> DataFrame:
        """Rows (query, point_id, score), query being the place in the list of queries, each with its first `limit` points; a shard is loaded once for all queries.

        Each shard gives what a beam of max(ef, limit) finds. allowed: a table of the ids that may be returned, of any
        size; removed ids are never returned. Nodes that may not be returned still route; if fewer than a quarter of a
        shard may be, the walk also looks two steps ahead.
        """
        check_limit(limit)
        p = self._properties()
        metric, width = p["metric"], max(ef, limit)
        q = np.array([vectors.check_vector(x, p["dims"]) for x in queries])
        shards = self.table.read().select("segment", "ids")
        if allowed is not None or bool(self.gone.version()):
            # the ids of a shard are a column of their own: at most a shard's rows each
            named = shards.withColumn("shard", F.xxhash64("segment"))
            ids = named.select("shard", F.explode("ids").alias("point_id"))
            if allowed is not None:
                ids = ids.join(allowed.select(F.col(allowed.columns[0]).cast("bigint").alias("point_id")), "point_id", "left_semi")
            ids = self._live(ids).groupBy("shard").agg(F.collect_list("point_id").alias("ids"))
            shards = named.select("segment", "shard").join(ids, "shard").select("segment", "ids")
        else:
            shards = shards.select("segment", F.lit(None).cast("array<bigint>").alias("ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for segment, ids in zip(batch.column(0), batch.column(1), strict=True):
                    graph, x = ShardGraph.load(segment.as_py(), metric)
                    mask = None if not ids.is_valid else np.isin(graph.ids, ids.values.to_numpy())
                    for i in range(len(q)):
                        found = np.array(graph.search(q[i], width, mask, limit), np.int64)
                        score = scoring.scores_of(metric, x[graph.of[found]].astype(np.float64), q[i])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(graph.ids[found]), pa.array(score)], ["query", "point_id", "score"])

        hits = shards.mapInArrow(run, "query int, point_id bigint, score double")
        order = Window.partitionBy("query").orderBy("score", "point_id")
        return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")

    def status(self) -> DataFrame:
        """One row (status, shards, rows): every segment is read and its checksum tested."""
        try:
            p = self._properties()
        except NotReady:
            return self.spark.createDataFrame([("index_not_ready", 0, 0)], "status string, shards bigint, rows bigint")
        metric = p["metric"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for segment in batch.column(0).to_pylist():
                    try:
                        good.append(len(ShardGraph.load(segment, metric)[0].ids))
                    except Corrupt:
                        good.append(-1)
                yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["n"])

        checked = self.table.read().select("segment").mapInArrow(run, "n bigint")
        return checked.agg(F.when(F.min("n") < 0, "index_corrupt").otherwise("ready").alias("status"), F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"))
