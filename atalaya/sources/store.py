"""Stored tables that change in place: rows in buckets of their key, and one list of files that makes a change current.

A table's rows lie in folders by the hash of their key. A change reads and rewrites the buckets of the keys it touches;
the files of all others stay. What is current is a manifest: a small table of (tabla, cubo, carpeta), written by
Spark for all tables at once. A commit makes it current by one marker file that only one writer can create, so a change
of several tables is seen whole or not at all, and a job lost before that leaves the old version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "cubo"
MANIFEST = "tabla string, cubo int, carpeta string"


class Conflict(RuntimeError):
    """Another change became current since this one began."""


class Restricted(RuntimeError):
    """Rows that stay still point to rows that were to go."""


class Store:
    """Tables under one folder: ``keys`` names each table's key columns, ``schemas`` its columns.

    The manifest has one row per table and bucket, so the driver holds a bounded list: with 10,000 buckets a table of
    100 TB has buckets of 10 GB, which Spark reads in splits. The file system must refuse to create a file that exists.
    """

    def __init__(
        self, spark: SparkSession, root: str, keys: Mapping[str, list[str]], schemas: Mapping[str, str | StructType], buckets: int = 64
    ) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.keys, self.schemas = dict(keys), dict(schemas)

    # --- files -----------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(f.getPath().getName() for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def _marker(self, name: str) -> str:
        """The manifest that a marker names; empty for a marker whose writer was lost."""
        size = self._files.getFileStatus(self._path(f"commits/{name}")).getLen()
        if not size:
            return ""
        stream = self._files.open(self._path(f"commits/{name}"))
        try:
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    # --- versions --------------------------------------------------------------
    def version(self) -> int:
        """The number of the current version, 0 before the first."""
        return next((int(n) for n in reversed(self._names("commits")) if self._marker(n)), 0)

    def files(self, version: int | None = None) -> dict[tuple[str, int], str]:
        """Folder by (table, bucket) of a version, the current one by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        name = self._marker(f"{version:012d}")
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/{name}").collect()
        return {(r["tabla"], r["cubo"]): r["carpeta"] for r in rows}

    def begin(self) -> Change:
        return Change(self)

    def read(self, table: str) -> DataFrame:
        """The current rows of a table."""
        return self.begin().read(table)

    def recover(self, keep: int = 2) -> int:
        """Delete what no version needs: files of lost changes, and versions but the last ``keep``. Returns folders deleted.

        Not to be run while another change is being written.
        """
        named = {n: self._marker(n) for n in self._names("commits")}
        good = [n for n in sorted(named) if named[n]]
        live = good[-keep:]
        used = {folder.rsplit(f"/{BUCKET}=", 1)[0] for n in live for folder in self.files(int(n)).values()}
        gone = [f"commits/{n}" for n in named if n not in live]
        gone += [f"manifests/{n}" for n in self._names("manifests") if n not in {named[x] for x in live}]
        for table in self._names("data"):
            gone += [f"data/{table}/{n}" for n in self._names(f"data/{table}") if f"data/{table}/{n}" not in used]
        for name in gone:
            self._files.delete(self._path(name), True)
        return len(gone)


class Change:
    """A change of one or more tables. Reads see the version it began from; nothing is current before ``commit``."""

    def __init__(self, store: Store) -> None:
        self.store, self.base = store, store.version()
        self.current = store.files(self.base)
        self.next = dict(self.current)

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.store.keys[table]), F.lit(self.store.buckets)).cast("int")

    def read(self, table: str, touched: set[int] | None = None, pending: bool = False) -> DataFrame:
        """Rows of the version it began from, or with ``pending`` as this change has left them so far."""
        files = self.next if pending else self.current
        folders = [f for (t, b), f in files.items() if t == table and (touched is None or b in touched)]
        spark, schema = self.store.spark, self.store.schemas[table]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.store.root}/{f}" for f in sorted(folders)))

    def touched(self, table: str, keys: DataFrame) -> set[int]:
        """Buckets of some keys: one partial aggregate, at most as many rows as buckets."""
        return {r[0] for r in keys.select(self._bucket(table)).distinct().collect()}

    def _write(self, table: str, rows: DataFrame, touched: set[int]) -> None:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        columns = self.store.spark.createDataFrame([], self.store.schemas[table]).columns
        # A large bucket is sorted and written by several tasks: one task would spill it.
        placed = rows.select(*columns, self._bucket(table).alias(BUCKET)).hint("rebalance", BUCKET)
        placed.write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        filled = {int(n.split("=")[1]) for n in self.store._names(folder) if n.startswith(f"{BUCKET}=")}
        for bucket in touched:
            self.next.pop((table, bucket), None)
        self.next |= {(table, b): f"{folder}/{BUCKET}={b}" for b in filled}

    def merge(self, table: str, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of the new rows' keys by ``merged(stored rows of these buckets, new rows)``."""
        touched = self.touched(table, new)
        if touched:
            self._write(table, merged(self.read(table, touched, pending=True), new), touched)

    def put(self, table: str, rows: DataFrame) -> None:
        """Rows in full: those with a stored key take its place, others are added."""
        keys = self.store.keys[table]
        kept = lambda stored, new: stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(
            new.select(*stored.columns)
        )
        self.merge(table, rows, kept)

    def delete(self, table: str, gone: DataFrame) -> None:
        """Remove the rows whose key columns are in ``gone``."""
        keys = self.store.keys[table]
        gone = gone.select(*keys).distinct()
        touched = self.touched(table, gone)
        if touched:
            self._write(table, self.read(table, touched, pending=True).join(gone, keys, "left_anti"), touched)

    def commit(self) -> int:
        """Make all of it current at once; returns the version's number."""
        store = self.store
        if store.version() != self.base:
            raise Conflict(f"version {store.version()} became current after {self.base}")
        name, version = uuid.uuid4().hex, self.base + 1
        rows = [(t, b, f) for (t, b), f in sorted(self.next.items())]
        store.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{store.root}/manifests/{name}")
        marker = store._path(f"commits/{version:012d}")
        if store._files.exists(marker) and not store._marker(f"{version:012d}"):
            store._files.delete(marker, False)  # its writer was lost before it named a manifest
        try:
            stream = store._files.create(marker, False)
        except Exception as e:
            raise Conflict(f"version {version} is being written by another change") from e
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        self.base, self.current = version, dict(self.next)
        return version


def upsert_incremental(store: Store, table: str, new: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Commit an upsert that reads and rewrites only the buckets of the new rows' keys."""
    change = store.begin()
    change.merge(table, new, upsert)
    return change.commit()


def delete_sources(store: Store, which: Column | DataFrame, commit: bool = True) -> int:
    """Delete sources (a condition, or a table of their ids) with captures, calls, events and notifications in one commit; audit rows lose the reference.

    Events must not outlive their capture: if an event of a call that stays points to a capture that is to go, the
    change is refused and nothing becomes current. The check reads the version that the change begins from, and the
    commit fails if another one became current meanwhile. Without ``commit`` the files are written and left.
    """
    change = store.begin()
    sources = change.read("fuentes")
    named = isinstance(which, DataFrame)
    dead = (sources.join(which, "id", "left_semi") if named else sources.where(F.coalesce(which, F.lit(False)))).select("id")
    of_dead = dead.withColumnRenamed("id", "fuente_id")
    captures = change.read("snapshots").join(of_dead, "fuente_id", "left_semi").select("id")
    calls = change.read("convocatorias").join(of_dead, "fuente_id", "left_semi").select("id")
    events, notes = _below(change, calls)
    staying = change.read("historial_cambios").join(events, "id", "left_anti")
    blocks = staying.join(captures.withColumnRenamed("id", "snapshot_id"), "snapshot_id", "left_semi").count()
    if blocks:
        raise Restricted(f"{blocks} events point to captures of the sources")
    audit = change.read("audit_logs")
    change.put("audit_logs", audit.join(of_dead, "fuente_id", "left_semi").withColumn("fuente_id", F.lit(None).cast(audit.schema["fuente_id"].dataType)))
    for table, gone in (("notificaciones", notes), ("historial_cambios", events), ("convocatorias", calls), ("snapshots", captures), ("fuentes", dead)):
        change.delete(table, gone)
    return change.commit() if commit else 0


def delete_calls(store: Store, which: Column, commit: bool = True) -> int:
    """Delete calls with their events and notifications in one commit."""
    change = store.begin()
    calls = change.read("convocatorias").where(F.coalesce(which, F.lit(False))).select("id")
    events, notes = _below(change, calls)
    for table, gone in (("notificaciones", notes), ("historial_cambios", events), ("convocatorias", calls)):
        change.delete(table, gone)
    return change.commit() if commit else 0


def _below(change: Change, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of the events of some calls, and of the notifications of these events."""
    of_calls = calls.withColumnRenamed("id", "convocatoria_id")
    events = change.read("historial_cambios").join(of_calls, "convocatoria_id", "left_semi").select("id")
    of_events = events.withColumnRenamed("id", "historial_cambios_id")
    return events, change.read("notificaciones").join(of_events, "historial_cambios_id", "left_semi").select("id")
