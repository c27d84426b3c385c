"""Connectors by type: a Python data source for vaults of notes, and a registry of providers."""

from __future__ import annotations

import bisect
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.functions.ids import UNIT_SEPARATOR
from quarry.sources.shared import staged
from quarry.sources.vault import LONGEST_FILE, note_columns

IGNORED = (".obsidian", ".git", ".trash")
FILE = "external_id string, content string, content_hash string, modified_at timestamp, size long"
_FILE = pa.schema([("external_id", pa.string()), ("content", pa.string()), ("content_hash", pa.string()), ("modified_at", pa.timestamp("us", "UTC")), ("size", pa.int64())])
#: Files that one task reads, and records that one page may ask for.
FILES_A_TASK, LONGEST_PAGE = 200, 10_000


def allowed_root(path: str, allowed: tuple[str, ...]) -> str:
    """The real path of an existing directory within the allowed ones."""
    real = os.path.realpath(path)
    if not os.path.isdir(real):
        raise ValueError(f"{path} is no directory")
    if not any(real == a or real.startswith(a + os.sep) for a in map(os.path.realpath, allowed)):
        raise ValueError(f"{path} is outside the allowed roots")
    return real


def list_notes(root: str, ignored: tuple[str, ...] = IGNORED) -> list[str]:
    """Paths of the .md files below root, relative and in order. Symbolic links are neither listed nor
    followed, ignored directories are not entered."""
    out = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in ignored and not os.path.islink(os.path.join(folder, n))]
        for f in files:
            path = os.path.join(folder, f)
            if f.lower().endswith(".md") and f not in ignored and not os.path.islink(path) and os.path.isfile(path):
                out.append(os.path.relpath(path, root).replace(os.sep, "/"))
    return sorted(out)


def read_note(root: str, name: str, longest: int) -> tuple:
    """One file as (external_id, content, content_hash, modified_at, size). A file that has become a
    link, leaves the root, is too long or is not UTF-8 is an error, not a record left out."""
    path = os.path.join(root, name)
    real = os.path.realpath(path)
    if os.path.islink(path) or not real.startswith(root + os.sep):
        raise PermissionError(f"{name} leaves the vault")
    with open(real, "rb") as f:
        info = os.fstat(f.fileno())
        if info.st_size > longest:
            raise ValueError(f"{name} has {info.st_size} bytes, more than {longest}")
        data = f.read()
    return name, data.decode("utf-8"), hashlib.sha256(data).hexdigest(), datetime.fromtimestamp(info.st_mtime, UTC), info.st_size


def snapshot_of(root: str, names: list[str]) -> str:
    return hashlib.sha256("\n".join([root, *names]).encode()).hexdigest()


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _tasks(names: list[str]) -> list[Files]:
    """At least one, which may be empty."""
    return [Files([])] if not names else [Files(names[i : i + FILES_A_TASK]) for i in range(0, len(names), FILES_A_TASK)]


class _Vault:
    """Options of a vault: path; files (a JSON list of relative paths) or offset and limit for a part of it;
    maxFileBytes. Driver and executors have to see the path alike."""

    def __init__(self, options: dict, allowed: tuple[str, ...]):
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError("a vault needs a path")
        self.root = allowed_root(options["path"], allowed)
        self.longest = int(options.get("maxfilebytes", LONGEST_FILE))
        self.files = json.loads(options["files"]) if "files" in options else None
        self.offset, self.limit = int(options.get("offset", 0)), int(options["limit"]) if "limit" in options else None
        if self.offset < 0 or self.limit is not None and not 1 <= self.limit <= LONGEST_PAGE:
            raise ValueError(f"offset from 0, limit from 1 to {LONGEST_PAGE}")

    def names(self) -> list[str]:
        names = list_notes(self.root) if self.files is None else self.files
        if self.offset > len(names):
            raise ValueError(f"offset {self.offset} is outside the {len(names)} files of the vault")
        return names[self.offset : None if self.limit is None else self.offset + self.limit]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(read_note(self.root, name, self.longest), _FILE, strict=True)], schema=_FILE)


class VaultReader(_Vault, DataSourceReader):
    def partitions(self) -> list[Files]:
        return _tasks(self.names())


class VaultStream(_Vault, DataSourceStreamReader):
    """The files in their order of path, frozen when the stream begins; the offset is the number of files
    given so far and the digest of the list they were counted in. A stream that goes on with another list gives
    all of it again, since new files may stand anywhere in it: what is known already changes nothing."""

    def __init__(self, options: dict, allowed: tuple[str, ...]):
        super().__init__(options, allowed)
        self.frozen = _Vault.names(self)
        self.snapshot = snapshot_of(self.root, self.frozen)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": 0, "snapshot": self.snapshot}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": len(self.frozen), "snapshot": self.snapshot}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        same = start["snapshot"] == end["snapshot"] == self.snapshot
        return _tasks(self.frozen[start["offset"] : end["offset"]] if same else self.frozen)

    def commit(self, end: dict) -> None:
        pass


def vault_format(allowed: tuple[str, ...]) -> type[DataSource]:
    """The data source `quarry-vault`, which opens only what lies within the allowed roots."""

    class VaultSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quarry-vault"

        def schema(self) -> str:
            return FILE

        def reader(self, schema) -> DataSourceReader:
            return VaultReader(dict(self.options), allowed)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return VaultStream(dict(self.options), allowed)

    return VaultSource


@dataclass(frozen=True)
class Definition:
    """A configured connector of a space."""

    connector_id: str
    type: str
    tenant_id: str
    space_id: str
    config: dict[str, str] = field(default_factory=dict)
    authority: int = 70

    def required(self, name: str) -> str:
        value = (self.config.get(name) or "").strip()
        if not value:
            raise ValueError(f"connector {self.connector_id} lacks {name}")
        return value


@dataclass(frozen=True)
class Page:
    """Records of one pull, the offset of the next one (0 after the last) and whether there is one."""

    records: DataFrame
    next_offset: int
    has_more: bool


class VaultConnector:
    """One vault, its files frozen when it is opened; snapshot_id names that list."""

    def __init__(self, spark: SparkSession, definition: Definition, root: str, longest: int):
        self.spark, self.definition, self.root, self.longest = spark, definition, root, longest
        self.vault = definition.required("vaultName")
        self.names = list_notes(root)
        self.snapshot_id = snapshot_of(root, self.names)

    def pull(self, offset: int, limit: int) -> Page:
        if not 1 <= limit <= LONGEST_PAGE:
            raise ValueError(f"limit from 1 to {LONGEST_PAGE}")
        if not 0 <= offset <= len(self.names):
            raise ValueError(f"offset {offset} is outside the {len(self.names)} files of the snapshot")
        end = min(len(self.names), offset + limit)
        files = self.spark.read.format("quarry-vault").options(path=self.root, files=json.dumps(self.names[offset:end]), maxFileBytes=self.longest).load()
        more = end < len(self.names)
        return Page(self.records(files), end if more else 0, more)

    def stream(self) -> DataFrame:
        return self.records(self.spark.readStream.format("quarry-vault").options(path=self.root, maxFileBytes=self.longest).load())

    def records(self, files: DataFrame) -> DataFrame:
        """Files as source records: links, embeds and tags join the metadata of the front matter."""
        d = self.definition
        note = note_columns(F.col("content"), F.regexp_extract("external_id", "([^/]*)$", 1))
        lists = F.create_map(*[x for k in ("wikilinks", "embeds", "tags") for x in (F.lit(f"obsidian.{k}"), F.array_join(note[k], UNIT_SEPARATOR))])
        own = F.map_filter(note["metadata"], lambda k, v: ~k.isin("obsidian.wikilinks", "obsidian.embeds", "obsidian.tags"))
        entries = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, lists))))
        return files.select(
            F.lit(d.tenant_id).alias("tenant_id"),
            F.lit(d.space_id).alias("space_id"),
            F.lit(d.connector_id).alias("connector_id"),
            "external_id",
            F.lit("OBSIDIAN").alias("source_type"),
            F.concat(F.lit("obsidian://open?vault="), F.url_encode(F.lit(self.vault)), F.lit("&file="), F.url_encode("external_id")).alias("source_uri"),
            note["title"].alias("title"),
            F.lit(d.authority).alias("authority"),
            F.to_json(entries).alias("metadata"),
            F.lit("text/markdown").alias("media_type"),
            F.lit(d.config.get("language", "und")).alias("language"),
            "content",
            "modified_at",
            F.lit(False).alias("deleted"),
        )


class TableConnector:
    """Records of a table, in an order that is frozen when it is opened: written once, numbered by what the
    parts before theirs hold, so that no task sees them all."""

    def __init__(self, definition: Definition, records: DataFrame, order: list[str]):
        self.definition = definition
        place = F.monotonically_increasing_id()
        rows = self.rows = staged(records.orderBy(*order).withColumn("place", place), "snapshot")
        sizes = rows.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a task
        before, self.n = [], 0
        for r in sizes:
            before.append((r["part"], self.n))
            self.n += r["n"]
        self.before = before
        self.snapshot_id = hashlib.sha256(repr([definition.connector_id, rows.inputFiles()[:1], self.n]).encode()).hexdigest()

    def pull(self, offset: int, limit: int) -> Page:
        if not 1 <= limit <= LONGEST_PAGE or not 0 <= offset <= self.n:
            raise ValueError(f"offset from 0 to {self.n}, limit from 1 to {LONGEST_PAGE}")
        return self._range(offset, min(self.n, offset + limit))

    def pull_pages(self, offset: int, limit: int, pages: int) -> tuple[Page, int]:
        """As many pages of `limit` records as there are, up to `pages`, as one range, and their number."""
        if not 1 <= limit <= LONGEST_PAGE or not 0 <= offset <= self.n or pages < 1:
            raise ValueError(f"offset from 0 to {self.n}, limit from 1 to {LONGEST_PAGE}, a page at least")
        end = min(self.n, offset + limit * pages)
        return self._range(offset, end), max(1, -(-(end - offset) // limit))

    def _range(self, offset: int, end: int) -> Page:
        """Numbers rise with places, so that a range of them is one of places, of which Parquet reads little else."""
        page = self.rows.where((F.col("place") >= self._place(offset)) & (F.col("place") < self._place(end))).drop("place")
        return Page(page, end if end < self.n else 0, end < self.n)

    def _place(self, number: int) -> int:
        """The place of a record's number; one behind all for the number behind the last."""
        if number >= self.n:
            return (1 << 63) - 1
        part, before = self.before[bisect.bisect_right(self.before, number, key=lambda x: x[1]) - 1]
        return (part << 33) + number - before


class SourceRegistry:
    """One provider for each connector type."""

    def __init__(self, spark: SparkSession):
        self.spark, self.providers = spark, {}

    def register(self, kind: str, provider: Callable[[SparkSession, Definition], object]) -> None:
        if kind in self.providers:
            raise ValueError(f"connector type {kind} has a provider")
        self.providers[kind] = provider

    def open(self, definition: Definition):
        if definition.type not in self.providers:
            raise ValueError(f"no provider for connector type {definition.type}")
        return self.providers[definition.type](self.spark, definition)


def vault_provider(spark: SparkSession, allowed: tuple[str, ...], longest: int = LONGEST_FILE) -> Callable:
    """Registers the data source and gives the provider of type OBSIDIAN for vaults within allowed roots."""
    spark.dataSource.register(vault_format(allowed))

    def provide(spark: SparkSession, definition: Definition) -> VaultConnector:
        return VaultConnector(spark, definition, allowed_root(definition.required("vaultPath"), allowed), longest)

    return provide
