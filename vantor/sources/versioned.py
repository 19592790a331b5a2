"""Versioned tables: immutable Parquet files under immutable manifests, with deletion vectors, and the diff of two versions.

A table is a folder with data files, deletion vectors and a log. Version n is described wholly by the manifest
_log/n.json: its data files with row counts, each with the deletion vector that hides some of its rows, and properties.
A manifest is put in place by an atomic rename that fails if the version exists, so that of two writers one loses and
nothing half-written is ever visible. Files are never changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vantor.errors import Conflict, UnknownTable


@dataclass(frozen=True)
class Manifest:
    """One version: file name -> name of its deletion vector, or None; properties hold what a commit wants to remember; born: file name -> version that added it."""

    version: int
    schema: str
    files: dict[str, str | None] = field(default_factory=dict)
    properties: dict[str, object] = field(default_factory=dict)
    born: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._new_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _at(self, *parts: str):
        return self._new_path("/".join((self.path, *parts)))

    def version(self) -> int:
        """The newest version; 0 for a table that has none."""
        log = self._at("_log")
        if not self._fs.exists(log):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if version == 0:
            return Manifest(0, "")
        if not self._fs.exists(self._at("_log", f"{version:010d}.json")):
            raise UnknownTable(f"{self.path} has no version {version}")
        stream = self._fs.open(self._at("_log", f"{version:010d}.json"))
        try:
            return Manifest(**json.loads(self._io.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _put(self, manifest: Manifest) -> None:
        born = {f: manifest.born.get(f, manifest.version) for f in manifest.files}
        text = json.dumps(manifest.__dict__ | {"born": born})
        draft = self._at("_log", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        final = self._at("_log", f"{manifest.version:010d}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest.version} of {self.path} was written by someone else")

    def _rows(self, files: list[str], schema: str) -> DataFrame:
        """Rows of the files with _file and _row, their places."""
        df = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in files))
        return df.select("*", F.element_at(F.split("_metadata.file_path", "/data/"), -1).alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _hidden(self, vectors: list[str]) -> DataFrame:
        return self.spark.read.schema("_file string, _row bigint").parquet(*(f"{self.path}/deleted/{v}" for v in vectors))

    def _visible(self, m: Manifest, files: list[str]) -> DataFrame | None:
        if not files:
            return None
        rows = self._rows(files, m.schema)
        vectors = sorted({v for f in files if (v := m.files[f])})
        return rows.join(self._hidden(vectors), ["_file", "_row"], "left_anti") if vectors else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if not m.schema:
            raise UnknownTable(f"{self.path} has no version")
        rows = self._visible(m, sorted(m.files))
        return self.spark.createDataFrame([], m.schema) if rows is None else rows.drop("_file", "_row")

    def commit(
        self, added: DataFrame | None = None, delete: Column | None = None, base: int | None = None, properties: dict[str, object] | None = None, delete_keys: DataFrame | None = None
    ) -> int:
        """Writes the next version: without the rows for which `delete` is true, with the rows `added`. Returns its number.

        delete_keys: a table with one row per key (columns of the table); rows with such a key are deleted.

        base: the version it must follow, else Conflict. Deleted rows are listed in a new deletion vector per commit
        that also repeats what the touched files hid before; a file of which no row is left is removed. properties are
        saved in the same manifest, hence with the data or not at all; those of older versions hold on until replaced.
        """
        m = self.manifest(base)
        files = dict(m.files)
        if (delete is not None or delete_keys is not None) and files:
            rows = self._visible(m, sorted(files))
            name = uuid.uuid4().hex
            hit = rows if delete is None else rows.where(delete)
            if delete_keys is not None:
                hit = hit.join(delete_keys, delete_keys.columns, "left_semi")
            hit = hit.select("_file", "_row")
            hit.write.parquet(f"{self.path}/deleted/{name}-new")
            hit = self._hidden([f"{name}-new"])
            touched = sorted(r[0] for r in hit.select("_file").distinct().collect())  # file names of the table, as in the manifest
            if touched:
                old = sorted({v for f in touched if (v := files[f])})
                kept = [hit] + ([self._hidden(old).where(F.col("_file").isin(touched))] if old else [])
                whole = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
                whole.write.parquet(f"{self.path}/deleted/{name}")
                sizes = {r[0]: r[1] for r in self._hidden([name]).groupBy("_file").count().collect()}
                totals = {r[0]: r[1] for r in self._rows(touched, m.schema).groupBy("_file").count().collect()}
                for f in touched:
                    if sizes[f] == totals[f]:
                        del files[f]
                    else:
                        files[f] = name
        schema = m.schema
        if added is not None:
            schema = schema or _schema(added)
            files |= self._write(added)
        self._put(Manifest(m.version + 1, schema, files, m.properties | (properties or {}), m.born))
        return m.version + 1

    def load(self, rows: DataFrame, epoch: str, epochs: int) -> list[int]:
        """One commit per delivery, written in one job: rows whose column `epoch` is i, from 0 to epochs - 1, come with the i-th of the new versions, which are returned.

        The column itself isn't kept. A delivery without rows gives a version without new files.
        """
        m, name = self.manifest(), uuid.uuid4().hex
        schema, files = m.schema or _schema(rows.drop(epoch)), dict(m.files)
        rows.withColumnRenamed(epoch, "_epoch").write.partitionBy("_epoch").parquet(f"{self.path}/data/{name}")
        versions = []
        for i in range(epochs):
            folder = self._at("data", name, f"_epoch={i}")
            if self._fs.exists(folder):
                files |= {f"{name}/_epoch={i}/{s.getPath().getName()}": None for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")}
            m = Manifest(m.version + 1, schema, dict(files), m.properties, m.born)
            self._put(m)
            m = self.manifest(m.version)
            versions.append(m.version)
        return versions

    def replace(self, rows: DataFrame, base: int | None = None, properties: dict[str, object] | None = None) -> int:
        """Writes the next version, which holds just these rows."""
        m = self.manifest(base)
        self._put(Manifest(m.version + 1, m.schema or _schema(rows), self._write(rows), m.properties | (properties or {})))
        return m.version + 1

    def _write(self, rows: DataFrame) -> dict[str, str | None]:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        files = [s.getPath().getName() for s in self._fs.listStatus(self._at("data", name))]
        return {f"{name}/{f}": None for f in files if f.endswith(".parquet")}

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows with _change "insert" or "delete" that lead from one version to another, from the manifests' difference.

        Only files that one of the manifests lacks, or whose deletion vectors differ, are read: rows of added files and
        rows that came out of hiding are inserts, rows of removed files and rows that were hidden are deletes.
        """
        old, new = self.manifest(since), self.manifest(until)
        schema = new.schema or old.schema
        if not schema:
            raise UnknownTable(f"{self.path} has no version")
        changed = sorted(f for f in new.files.keys() & old.files.keys() if new.files[f] != old.files[f])
        parts = []
        for kind, one, other in (("insert", new, old), ("delete", old, new)):
            alone = self._visible(one, sorted(one.files.keys() - other.files.keys()))
            if alone is not None:
                parts.append(alone.withColumn("_change", F.lit(kind)))
            vectors = sorted({v for f in changed if (v := other.files[f])})
            if vectors:
                seen = self._visible(one, changed).join(self._hidden(vectors), ["_file", "_row"], "left_semi")
                parts.append(seen.withColumn("_change", F.lit(kind)))
        if not parts:
            return self.spark.createDataFrame([], schema + ", _change string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("_file", "_row")


    def changes_by(self, key: str, done: dict[object, int], rest: int = 0, until: int | None = None) -> DataFrame:
        """changes() where each value of the column `key` has its own version from which on changes count: done's, or `rest` for values (and null) that done lacks.

        Files that were there at the least of those versions are not read, and files older than all of done's versions only
        for other keys. As long as files were only added, one pass does: a row counts if its file was added after its
        key's version.
        """
        now, first = self.manifest(until), min([rest, *done.values()])
        old = self.manifest(first)
        if now.version == 0:
            raise UnknownTable(f"{self.path} has no version")
        kind = StructType.fromDDL(now.schema)[key].dataType
        marked = [old, *(self.manifest(v) for v in sorted(set(done.values()) - {first, now.version}))]
        if not any(any(m.files.values()) or m.files.keys() - now.files.keys() for m in [now, *marked]):
            added = {f: now.born[f] for f in now.files.keys() - old.files.keys()}
            least = min(done.values(), default=rest)
            late, early = ({f: v for f, v in added.items() if (v > least) == after} for after in (True, False))
            parts = []
            if late:
                born = F.broadcast(self.spark.createDataFrame(sorted(late.items()), "_file string, _born int"))  # a row per file, out of the manifest
                marks = self.spark.createDataFrame(list(done.items()), StructType([StructField("_key", kind), StructField("_done", IntegerType())]))
                rows = self._rows(sorted(late), now.schema).drop("_row").join(born, "_file").join(F.broadcast(marks), F.col(key) == F.col("_key"), "left")
                parts.append(rows.where(F.col("_born") > F.coalesce("_done", F.lit(rest))).drop("_file", "_born", "_key", "_done"))
            if early:  # before the first of done's versions only other keys have news
                other = F.col(key).isNull() | ~F.col(key).isin(list(done)) if done else F.lit(True)
                parts.append(self._rows(sorted(early), now.schema).where(other).drop("_file", "_row"))
            if not parts:
                return self.spark.createDataFrame([], now.schema + ", _change string")
            return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("_change", F.lit("insert"))
        out = None
        for version in sorted({rest, *done.values()}):
            own = [k for k, v in done.items() if v == version]
            among = F.coalesce(F.col(key).isin(own), F.lit(False)) if own else F.lit(False)
            if version == rest:
                among = among | ~F.coalesce(F.col(key).isin(list(done)), F.lit(False)) if done else F.lit(True)
            part = self.changes(version, now.version).where(among)
            out = part if out is None else out.unionByName(part)
        return out

    def seen_by(self, key: str, done: dict[object, int]) -> DataFrame:
        """Rows that were there at their key's version; keys that done lacks have none."""
        now = self.manifest()
        kind = StructType.fromDDL(now.schema)[key].dataType
        out = None
        names = sorted(f for f, v in now.born.items() if v <= max(done.values(), default=0))
        if not names or any(any(m.files.values()) or m.files.keys() - now.files.keys() for m in [now, *(self.manifest(v) for v in sorted(set(done.values())))]):
            for version in sorted(set(done.values())):
                part = self.read(version).where(F.col(key).isin([k for k, v in done.items() if v == version]))
                out = part if out is None else out.unionByName(part)
            return self.spark.createDataFrame([], now.schema) if out is None else out
        born = F.broadcast(self.spark.createDataFrame([(f, now.born[f]) for f in names], "_file string, _born int"))
        marks = self.spark.createDataFrame([(k, v) for k, v in done.items()], StructType([StructField("_key", kind), StructField("_done", IntegerType())]))
        rows = self._rows(names, now.schema).drop("_row").join(born, "_file").join(F.broadcast(marks), F.col(key) == F.col("_key"))
        return rows.where(F.col("_born") <= F.col("_done")).drop("_file", "_born", "_key", "_done")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def run_incremental(source: VersionedTable, target: VersionedTable, transform: Callable[[DataFrame], DataFrame], name: str = "source", key: str | None = None) -> int:
    """One run over what changed in `source` since the last run that was committed to `target`; returns the source version now covered.

    The version reached is a property of the target's own commit, so output and progress appear together or not at all.
    A run that fails leaves nothing behind, whatever it had written; the next one starts from the same version. A
    concurrent run loses at the commit (Conflict). Without changes nothing is written.

    key: a column of the source whose values may have been covered up to versions of their own, which a commit saved as
    progress(name, version, by_key); the run brings them all to one version.
    """
    base = target.version()
    saved = target.manifest(base).properties
    done, behind = int(saved.get(f"{name}_version", 0) or 0), {k: v for k, v in saved.get(f"{name}_versions", ())}
    now = source.version()
    if now == done and not any(v < now for v in behind.values()):
        return done
    changes = source.changes(done, now) if key is None else source.changes_by(key, behind, done, now)
    target.commit(transform(changes), base=base, properties=progress(name, now))
    return now


def progress(name: str, version: int, by_key: dict[object, int] | None = None) -> dict[str, object]:
    """Properties for a target's commit: the source version it covers, and those of single keys that stand elsewhere."""
    return {f"{name}_version": version, f"{name}_versions": [[k, v] for k, v in (by_key or {}).items()]}
