"""Collections over source tables: registrations, aliases, limits, points, models and migrations.

The catalog is a small driver-side object; everything that grows with the data (source tables, points) is a DataFrame.
It can be written to and read from a folder of the cluster's storage.
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.errors import BudgetExceeded, Duplicate, InvalidParameter, UnknownCollection, UnknownPayloadField, UnknownTable, UnknownVector, UnsupportedMetric, WrongColumnType
from vantor.functions.vectors import MAX_DIMENSIONS, METRICS
from vantor.plans.filters import Compiler, Field, check_key
from vantor.runtime import materialize, numbered

POINTS = T.StructType([T.StructField("point_id", T.LongType()), T.StructField("source_key", T.StringType()), T.StructField("deleted_at", T.TimestampType())])
STATUSES = ("ready", "building", "disabled", "failed")
MAX_LIMIT = 10_000


@dataclass
class VectorEntry:
    name: str
    column: str
    dims: int
    metric: str
    options: dict = field(default_factory=dict)
    quantization: dict = field(default_factory=dict)
    status: str = "ready"
    index: str | None = None


@dataclass
class Limits:
    strict_mode: bool = False
    max_dimensions: int | None = None
    max_vectors: int | None = None
    max_points: int | None = None
    max_filter_nodes: int | None = None
    max_search_limit: int | None = None
    max_candidate_budget: int | None = None
    query_timeout_ms: int | None = None
    max_index_memory_bytes: int | None = None


@dataclass
class Collection:
    collection_id: int
    name: str
    owner: str
    table: str | None = None
    revision: int = 1
    vectors: dict[str, VectorEntry] = field(default_factory=dict)
    sparse: dict[str, VectorEntry] = field(default_factory=dict)
    fields: dict[str, Field] = field(default_factory=dict)
    limits: Limits = field(default_factory=Limits)
    tokens: tuple[str, str] | None = None
    models: dict[tuple[str, str], dict] = field(default_factory=dict)


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MAX_LIMIT:
        raise InvalidParameter(f"a limit must be 1 to {MAX_LIMIT}")
    return limit


def check_name(name: str) -> str:
    if not name or len(name.encode()) > 63 or "\0" in name:
        raise InvalidParameter("a name has 1 to 63 bytes")
    return name


class Catalog:
    """Registered tables, collections and their points."""

    def __init__(self, spark: SparkSession, owner: str = "spark") -> None:
        self.spark, self.owner = spark, owner
        self.tables: dict[str, DataFrame] = {}
        self.collections: dict[str, Collection] = {}
        self.aliases: dict[str, str] = {}
        self.points: dict[int, DataFrame] = {}
        self.migrations: list[dict] = []
        self._next = 1

    # tables and collections

    def register_table(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame with the column id known as a source table; a later one of that name takes its place."""
        if "id" not in df.columns:
            raise UnknownPayloadField("a source table needs the column id")
        self.tables[name] = df

    def create_collection(self, name: str, table: str | None = None) -> Collection:
        check_name(name)
        if name in self.collections or name in self.aliases:
            raise Duplicate(f"collection {name} exists")
        if table is not None and table not in self.tables:
            raise UnknownTable(f"table {table} doesn't exist")
        c = Collection(self._next, name, self.owner, table)
        self._next += 1
        self.collections[name] = c
        self.points[c.collection_id] = self.spark.createDataFrame([], POINTS)
        return c

    def drop_collection(self, name: str) -> bool:
        c = self.collections.pop(name, None)
        if c is None:
            return False
        self.points.pop(c.collection_id)
        self.aliases = {a: t for a, t in self.aliases.items() if t != name}
        return True

    def exact(self, name: str) -> Collection:
        """The collection of that very name; aliases don't count."""
        if name not in self.collections:
            raise UnknownCollection(f"collection {name} doesn't exist")
        return self.collections[name]

    def resolve(self, name: str) -> Collection:
        """The collection of that name or alias."""
        return self.exact(self.aliases.get(name, name))

    def create_alias(self, alias: str, target: str) -> None:
        """Creates an alias, or points it to another collection."""
        check_name(alias)
        if alias in self.collections:
            raise Duplicate(f"{alias} is a collection")
        self.aliases[alias] = self.exact(target).name

    def drop_alias(self, alias: str) -> bool:
        return self.aliases.pop(alias, None) is not None

    def source(self, c: Collection) -> DataFrame:
        if c.table is None:
            raise InvalidParameter(f"collection {c.name} has no source table")
        if c.table not in self.tables:
            raise UnknownTable(f"table {c.table} doesn't exist")
        return self.tables[c.table]

    def _changed(self, c: Collection) -> None:
        c.revision += 1

    # vectors

    def _register(self, c: Collection, kind: str, entry: VectorEntry) -> VectorEntry:
        have, schema = getattr(c, kind), self.source(c).schema
        check_name(entry.name)
        if entry.metric in ("hamming", "jaccard"):
            raise UnsupportedMetric(f"{entry.metric} isn't served")
        if entry.metric not in METRICS:
            raise InvalidParameter(f"unknown metric {entry.metric}")
        if not 1 <= entry.dims <= MAX_DIMENSIONS:
            raise InvalidParameter("bad number of dimensions")
        if entry.column not in schema.fieldNames():
            raise UnknownPayloadField(f"column {entry.column} doesn't exist")
        t = schema[entry.column].dataType
        if kind == "vectors":
            good = isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType))
        else:
            good = isinstance(t, T.StructType) and {"dims", "indices", "values"} <= set(t.names)
        if not good:
            raise WrongColumnType(f"{entry.column} isn't a vector column")
        if entry.name in have or any(e.column == entry.column for e in have.values()):
            raise Duplicate(f"vector {entry.name} or its column is registered")
        if c.limits.strict_mode:
            if c.limits.max_dimensions is not None and entry.dims > c.limits.max_dimensions:
                raise BudgetExceeded("too many dimensions for the collection")
            if c.limits.max_vectors is not None and len(c.vectors) + len(c.sparse) >= c.limits.max_vectors:
                raise BudgetExceeded("too many vectors in the collection")
        have[entry.name] = entry
        self._changed(c)
        return entry

    def register_vector(self, collection: str, name: str, column: str, dims: int, metric: str) -> VectorEntry:
        return self._register(self.exact(collection), "vectors", VectorEntry(name, column, dims, metric))

    def register_sparse_vector(self, collection: str, name: str, column: str, dims: int, metric: str) -> VectorEntry:
        return self._register(self.exact(collection), "sparse", VectorEntry(name, column, dims, metric))

    def vector(self, c: Collection, name: str | None = None, sparse: bool = False) -> VectorEntry:
        """The vector of that name; without a name the collection must have just one."""
        have = c.sparse if sparse else c.vectors
        if name is None:
            if not have:
                raise UnknownVector(f"collection {c.name} has no vector")
            if len(have) > 1:
                raise InvalidParameter("specify a vector name")
            return next(iter(have.values()))
        if name not in have:
            raise UnknownVector(f"vector {name} isn't registered")
        return have[name]

    def configure_vector(self, collection: str, name: str, options: Mapping, quantization: Mapping, status: str, sparse: bool = False) -> VectorEntry:
        """Stores options and a status; they describe, and don't change how queries run."""
        if status not in STATUSES:
            raise InvalidParameter(f"status must be one of {', '.join(STATUSES)}")
        if not isinstance(options, Mapping) or not isinstance(quantization, Mapping):
            raise InvalidParameter("options must be objects")
        c = self.exact(collection)
        e = self.vector(c, name, sparse)
        e.options, e.quantization, e.status = dict(options), dict(quantization), status
        self._changed(c)
        return e

    def attach_index(self, collection: str, name: str, index: str, sparse: bool = False, metric: str | None = None) -> None:
        """Names the folder of an index for a vector (operators.ann, which search uses by its state), or a sparse one (operators.postings); the metric must be the registered one."""
        c = self.exact(collection)
        e = self.vector(c, name, sparse)
        if metric is not None and metric != e.metric:
            raise InvalidParameter("the index has another metric")
        e.index = index
        self._changed(c)

    # payload fields

    def _register_field(self, collection: str, key: str, f: Field) -> None:
        c = self.exact(collection)
        check_key(key)
        schema = self.source(c).schema
        if f.column not in schema.fieldNames():
            raise UnknownPayloadField(f"column {f.column} doesn't exist")
        if f.path is not None and not isinstance(schema[f.column].dataType, T.StringType):
            raise WrongColumnType(f"{f.column} isn't a column of JSON text")
        if key in c.fields or f in c.fields.values():
            raise Duplicate(f"filter key {key} or its column is registered")
        c.fields[key] = f
        self._changed(c)

    def register_filter_column(self, collection: str, key: str, column: str) -> None:
        self._register_field(collection, key, Field(column))

    def register_json_path(self, collection: str, key: str, column: str, path: Sequence[str]) -> None:
        if not path or not all(path) or len(path) > 16:
            raise InvalidParameter("a path has 1 to 16 segments")
        self._register_field(collection, key, Field(column, tuple(path)))

    def compiler(self, c: Collection, schema: T.StructType) -> Compiler:
        return Compiler(c.fields, schema)

    # limits

    def configure_limits(self, collection: str, **limits: int | bool | None) -> Limits:
        names = {f.name for f in dataclasses.fields(Limits)}
        for k, v in limits.items():
            if k not in names:
                raise InvalidParameter(f"unknown limit {k}")
            if k != "strict_mode" and v is not None and v <= 0:
                raise InvalidParameter("a limit must be positive")
        c = self.exact(collection)
        c.limits = dataclasses.replace(c.limits, **limits)
        self._changed(c)
        return c.limits

    def enforce_search(self, c: Collection, limit: int, candidates: int | None = None) -> int:
        check_limit(limit)
        if c.limits.strict_mode:
            if c.limits.max_search_limit is not None and limit > c.limits.max_search_limit:
                raise BudgetExceeded("limit exceeds the collection's")
            if candidates is not None and c.limits.max_candidate_budget is not None and candidates > c.limits.max_candidate_budget:
                raise BudgetExceeded("candidates exceed the collection's budget")
        return limit

    # points

    def _keys(self, keys: Sequence[str] | DataFrame) -> DataFrame:
        """Distinct keys; a DataFrame gives them in its first column."""
        if isinstance(keys, DataFrame):
            df = keys.select(F.col(keys.columns[0]).cast("string").alias("source_key"))
        else:
            df = self.spark.createDataFrame([(k,) for k in keys], "source_key string")
        return df.where(F.col("source_key").isNotNull()).distinct()

    def upsert_points(self, collection: str, keys: Sequence[str] | DataFrame) -> DataFrame:
        """Adds points for keys, or brings deleted ones back. Rows (point_id, source_key, inserted, reactivated).

        inserted is false for keys that were there, deleted or not; their ids stay. New ids follow the largest one in the
        order of the keys. Null keys are left out and repeated ones count once.
        """
        c = self.exact(collection)
        old = self.points[c.collection_id]
        both = materialize(self._keys(keys).join(old, "source_key", "left"), "upsert")
        known = both.where(F.col("point_id").isNotNull())
        if c.limits.strict_mode and c.limits.max_points is not None:
            if old.where(F.col("deleted_at").isNull()).count() + both.count() - known.where(F.col("deleted_at").isNull()).count() > c.limits.max_points:
                raise BudgetExceeded("too many points for the collection")
        largest = old.agg(F.max("point_id")).first()[0] or 0
        fresh = numbered(both.where(F.col("point_id").isNull()).select("source_key"), ["source_key"], largest, "point_id")
        report = known.select("point_id", "source_key", F.lit(False).alias("inserted"), F.col("deleted_at").isNotNull().alias("reactivated"))
        report = materialize(report.unionByName(fresh.select("point_id", "source_key", F.lit(True).alias("inserted"), F.lit(False).alias("reactivated"))), "report")
        kept = old.join(report.select("source_key"), "source_key", "left_anti")
        now = kept.unionByName(report.select("point_id", "source_key", F.lit(None).cast("timestamp").alias("deleted_at")))
        self.points[c.collection_id] = materialize(now.select(*POINTS.names), "points")
        return report

    def delete_points(self, collection: str, keys: Sequence[str] | DataFrame) -> DataFrame:
        """Marks active points as deleted; rows (point_id, source_key) of those. Their ids stay."""
        c = self.exact(collection)
        old = self.points[c.collection_id]
        hit = materialize(old.where(F.col("deleted_at").isNull()).join(self._keys(keys), "source_key", "left_semi").select("point_id", "source_key"), "deleted")
        now = old.join(hit.select("point_id", F.lit(True).alias("hit")), "point_id", "left")
        now = now.withColumn("deleted_at", F.when(F.col("hit"), F.current_timestamp()).otherwise(F.col("deleted_at"))).select(*POINTS.names)
        self.points[c.collection_id] = materialize(now, "points")
        return hit

    def _batches(self, report: DataFrame, batch: int, counts: Mapping[str, object]) -> DataFrame:
        if batch < 1:
            raise InvalidParameter("a batch has at least one row")
        rows = numbered(report, ["source_key"], 0, "n").withColumn("batch_number", F.ceil(F.col("n") / batch).cast("bigint"))
        return rows.groupBy("batch_number").agg(F.count(F.lit(1)).alias("processed_count"), *(F.sum(e.cast("bigint")).alias(n) for n, e in counts.items()))

    def bulk_upsert_points(self, collection: str, keys: Sequence[str] | DataFrame, batch: int = 1000) -> DataFrame:
        """As upsert_points; rows (batch_number, processed_count, inserted_count, reactivated_count), batches in the order of the keys."""
        return self._batches(self.upsert_points(collection, keys), batch, {"inserted_count": F.col("inserted"), "reactivated_count": F.col("reactivated")})

    def bulk_delete_points(self, collection: str, keys: Sequence[str] | DataFrame, batch: int = 1000) -> DataFrame:
        """As delete_points; rows (batch_number, processed_count, deleted_count, missing_count)."""
        wanted = materialize(self._keys(keys), "keys")
        hit = self.delete_points(collection, wanted).select("source_key", F.lit(True).alias("hit"))
        report = wanted.join(hit, "source_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        return self._batches(report, batch, {"deleted_count": F.col("hit"), "missing_count": ~F.col("hit")})

    def backfill_points(self, collection: str, batch: int = 1000) -> DataFrame:
        """Upserts a point for every row of the source table, in the order of the id's text."""
        return self.bulk_upsert_points(collection, self.source(self.exact(collection)).select(F.col("id").cast("string")), batch)

    def adopt_points(self, collection: str, points: DataFrame) -> None:
        """Takes a table (point_id, source_key, deleted_at) as the collection's points, e.g. one kept elsewhere; ids must be unique."""
        c = self.exact(collection)
        self.points[c.collection_id] = points.select(F.col("point_id").cast("bigint"), F.col("source_key").cast("string"), F.col("deleted_at").cast("timestamp"))

    def active(self, c: Collection) -> DataFrame:
        return self.points[c.collection_id].where(F.col("deleted_at").isNull()).select("point_id", "source_key")

    def scan(self, c: Collection) -> DataFrame:
        """Active points with their source rows: point_id, source_key and the source's columns under their names.

        Columns point_id and source_key of the source table itself are hidden by the points'.
        """
        source = self.source(c)
        names = [n for n in source.columns if n not in ("point_id", "source_key")]
        source = source.select(*(F.col(f"`{n}`") for n in names), F.col("id").cast("string").alias("_key"))
        return self.active(c).join(source, F.col("source_key") == F.col("_key")).drop("_key")

    # models and migrations

    def register_model_version(self, collection: str, model: str, version: str, dims: int, metric: str) -> dict:
        c = self.exact(collection)
        check_name(model), check_name(version)
        if metric not in METRICS:
            raise InvalidParameter(f"unknown metric {metric}")
        if not 1 <= dims <= MAX_DIMENSIONS:
            raise InvalidParameter("bad number of dimensions")
        if (model, version) in c.models:
            raise Duplicate(f"model {model} {version} is registered")
        c.models[model, version] = {"model_name": model, "model_version": version, "dimensions": dims, "metric": metric, "is_active": True}
        return c.models[model, version]

    def create_migration(self, collection: str, source: tuple[str, str], target: tuple[str, str], total: int) -> dict:
        c = self.exact(collection)
        if source == target:
            raise InvalidParameter("source and target are the same model")
        for m in (source, target):
            if m not in c.models:
                raise UnknownCollection(f"model {m[0]} {m[1]} isn't registered")
        if total < 0:
            raise InvalidParameter("negative number of points")
        m = {"migration_id": len(self.migrations) + 1, "collection_name": c.name, "source_model": source[0], "source_version": source[1], "target_model": target[0], "target_version": target[1], "status": "planned", "total_points": total, "processed_points": 0}
        self.migrations.append(m)
        return m

    def update_migration(self, migration_id: int, processed: int, status: str) -> dict:
        """Progress may also go back; any status may follow any other."""
        m = next((m for m in self.migrations if m["migration_id"] == migration_id), None)
        if m is None:
            raise UnknownCollection(f"migration {migration_id} doesn't exist")
        if not 0 <= processed <= m["total_points"]:
            raise InvalidParameter("progress must be 0 to the total")
        if status not in ("planned", "running", "completed", "failed"):
            raise InvalidParameter(f"unknown status {status}")
        m["processed_points"], m["status"] = processed, status
        return m

    # listings

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def collection_info(self, collection: str) -> DataFrame:
        c = self.resolve(collection)
        return self._frame([(c.collection_id, c.name, c.owner, c.table)], "collection_id bigint, collection_name string, owner_name string, table_name string")

    def collection_vectors(self, collection: str, sparse: bool = False) -> DataFrame:
        c = self.resolve(collection)
        rows = [(c.name, e.name, c.table, e.column, e.dims, e.metric, json.dumps(e.options), json.dumps(e.quantization), e.status, e.index) for e in sorted((c.sparse if sparse else c.vectors).values(), key=lambda e: e.name)]
        return self._frame(rows, "collection_name string, vector_name string, table_name string, vector_column string, dimensions int, metric string, options string, quantization string, status string, index string")

    def collection_aliases(self) -> DataFrame:
        return self._frame(sorted(self.aliases.items()), "alias_name string, collection_name string").orderBy("alias_name")

    def collection_limits(self, collection: str) -> DataFrame:
        row = dataclasses.astuple(self.resolve(collection).limits)
        return self._frame([row], ", ".join(f"{f.name} {'boolean' if f.name == 'strict_mode' else 'bigint'}" for f in dataclasses.fields(Limits)))

    def filter_fields(self, collection: str) -> DataFrame:
        c = self.resolve(collection)
        rows = [(c.name, k, c.table, f.column, list(f.path) if f.path else None) for k, f in sorted(c.fields.items())]
        return self._frame(rows, "collection_name string, filter_key string, table_name string, column_name string, json_path array<string>")

    def model_versions(self) -> DataFrame:
        rows = [(c.name, m["model_name"], m["model_version"], m["dimensions"], m["metric"], m["is_active"]) for c in self.collections.values() for m in c.models.values()]
        return self._frame(rows, "collection_name string, model_name string, model_version string, dimensions int, metric string, is_active boolean")

    def embedding_migrations(self) -> DataFrame:
        kinds = {"migration_id": "bigint", "total_points": "bigint", "processed_points": "bigint"}
        names = ["migration_id", "collection_name", "source_model", "source_version", "target_model", "target_version", "status", "total_points", "processed_points"]
        return self._frame([tuple(m[n] for n in names) for m in self.migrations], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))

    # keeping

    def save(self, path: str) -> None:
        """Writes registrations (as JSON text) and points under a folder that isn't there yet; source tables are registered anew after load."""
        state = {
            "next": self._next, "aliases": self.aliases, "migrations": self.migrations,
            "collections": [dataclasses.asdict(c) | {"models": list(c.models.values()), "fields": {k: [f.column, f.path] for k, f in c.fields.items()}} for c in self.collections.values()],
        }
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/catalog")
        for cid, points in self.points.items():
            points.write.parquet(f"{path}/points/{cid}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, owner: str = "spark") -> Catalog:
        state = json.loads(spark.read.text(f"{path}/catalog").first()[0])
        out = cls(spark, owner)
        out._next, out.aliases, out.migrations = state["next"], state["aliases"], state["migrations"]
        for c in state["collections"]:
            c["vectors"], c["sparse"] = ({k: VectorEntry(**v) for k, v in c[n].items()} for n in ("vectors", "sparse"))
            c["fields"] = {k: Field(f[0], tuple(f[1]) if f[1] else None) for k, f in c["fields"].items()}
            c["limits"], c["models"] = Limits(**c["limits"]), {(m["model_name"], m["model_version"]): m for m in c["models"]}
            c["tokens"] = tuple(c["tokens"]) if c["tokens"] else None
            out.collections[c["name"]] = Collection(**c)
            out.points[c["collection_id"]] = spark.read.schema(POINTS).parquet(f"{path}/points/{c['collection_id']}")
        return out


def valid_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name) is not None
