"""Tables that change together: a folder of Parquet parts under one commit marker for each version."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.state import latest
from quarry.sources.shared import CODEC

VERSION = "commit_version"


class Conflict(RuntimeError):
    """Another writer has committed since the transaction began: begin anew on what it wrote."""


@dataclass(frozen=True)
class TableSpec:
    """Columns as DDL. Rows of a table with a key replace earlier ones of it; without, they are added."""

    schema: str
    key: tuple[str, ...] = ()


class SnapshotStore:
    """Versioned tables below a root in any store that Spark writes.

    A transaction writes its rows into a part folder of each table that nothing refers to yet; the
    commit marker `_commits/<version>.json`, put in place by one rename that fails if the version
    exists, makes them all visible at once. A marker names every part of its version, so that readers open one
    small file, see whole versions only, and may ask for an earlier one. A writer that dies leaves parts
    without a marker: nobody reads them. A marker also holds the last batch that each application has
    applied, so that a batch delivered again changes nothing.

    Keyed tables are merged when read (the row of the latest version counts); compact() rewrites them, so
    that the number of parts stays small.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, TableSpec]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        self._no_overwrite = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        folder = self._path("_commits")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def marker(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "applied": {}, "parts": {}}
        stream = self._fs.open(self._path("_commits", f"{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def applied(self, app: str) -> int:
        """The last batch of an application that is in; -1 for none."""
        return self.marker()["applied"].get(app, -1)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the last by default)."""
        return self._merged(name, self.marker(version)["parts"].get(name, []))

    def _merged(self, name: str, parts: list[str]) -> DataFrame:
        spec = self.tables[name]
        if not parts:
            return self.spark.createDataFrame([], spec.schema)
        rows = self.spark.read.schema(f"{spec.schema}, {VERSION} long").parquet(*[f"{self.root}/{p}" for p in parts])
        if spec.key and len(parts) > 1:
            rows = latest(rows, list(spec.key), [F.desc(VERSION)])
        return rows.drop(VERSION)

    def begin(self, app: str, batch: int) -> Transaction:
        return Transaction(self, app, batch)

    def compact(self) -> int:
        """A version whose keyed tables are one part each; rows and applied batches stay the same."""
        now = self.marker()
        parts = dict(now["parts"])
        for name, spec in self.tables.items():
            if spec.key and len(parts.get(name, [])) > 1:
                part = f"{name}/{uuid.uuid4().hex}"
                self.read(name, now["version"]).withColumn(VERSION, F.lit(now["version"]).cast("long")).write.option("compression", CODEC).parquet(f"{self.root}/{part}")
                parts[name] = [part]
        return self._commit(now["version"], now["applied"], parts)

    def _commit(self, base: int, applied: dict[str, int], parts: dict[str, list[str]]) -> int:
        version = base + 1
        temporary = self._path("_commits", f".{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "applied": applied, "parts": parts}).encode()))
        finally:
            stream.close()
        try:
            self._context.rename(temporary, self._path("_commits", f"{version:020d}.json"), self._renames())
        except Exception as failure:
            self._fs.delete(temporary, False)
            if self.version() >= version:
                raise Conflict(f"version {version} of {self.root} exists") from failure
            raise
        return version

    def _renames(self):
        """Options for FileContext.rename: fail where the target exists."""
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._no_overwrite
        return options


class Transaction:
    """Rows for several tables, and the version that they are based on."""

    def __init__(self, store: SnapshotStore, app: str, batch: int):
        self.store, self.app, self.batch, self.base, self.written, self.staged = store, app, batch, store.marker(), {}, []

    @property
    def done(self) -> bool:
        """Whether this batch is in already: a replay has nothing to do."""
        return self.base["applied"].get(self.app, -1) >= self.batch

    def read(self, name: str) -> DataFrame:
        return self.store._merged(name, self.base["parts"].get(name, []))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write rows (their columns by name; those they lack are null) and give what was written, for later
        tables to build on."""
        spec = self.store.tables[name]
        columns = self.store.spark.createDataFrame([], spec.schema).schema
        part = f"{name}/{uuid.uuid4().hex}"
        own = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])
        own.withColumn(VERSION, F.lit(self.base["version"] + 1).cast("long")).write.option("compression", CODEC).parquet(f"{self.store.root}/{part}")
        self.written.setdefault(name, []).append(part)
        return self.store.spark.read.schema(columns).parquet(f"{self.store.root}/{part}")

    def stage(self, tag: str, rows: DataFrame) -> DataFrame:
        """Rows that this transaction uses several times, written; they go when it ends."""
        path = f"_work/{tag}-{uuid.uuid4().hex}"
        rows.write.option("compression", CODEC).parquet(f"{self.store.root}/{path}")
        self.staged.append(path)
        return self.store.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{path}")

    def discard(self) -> None:
        """Remove what stage() has written."""
        while self.staged:
            self.store._fs.delete(self.store._path(self.staged.pop()), True)

    def commit(self) -> int:
        """The new version. What was written is visible from here on, or, on a Conflict, never."""
        self.discard()
        parts = {name: [*self.base["parts"].get(name, []), *self.written.get(name, [])] for name in self.store.tables}
        return self.store._commit(self.base["version"], self.base["applied"] | {self.app: self.batch}, parts)
