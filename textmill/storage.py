"""Tables in a folder that the cluster shares, published version by version.

A store is a folder with data folders and numbered manifests. A commit writes
its tables as Parquet into a new data folder, then creates the next manifest,
which names the parts of every table. Creating a file that exists fails, so of
two writers one is refused, and a reader sees a commit whole or not at all.
What a failed commit leaves behind is named by no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from textmill.shipping import ensure_importable


class Conflict(RuntimeError):
    """Another writer has published the version."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master one under /tmp where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
            context.setCheckpointDir("/tmp/textmill-checkpoints")
        at = context.getCheckpointDir()
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows cut from their lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@dataclass(frozen=True)
class Manifest:
    """What a version holds: folders by table with their schemas, the batches that went in, and notes of its writer."""

    version: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)


class Store:
    """Versioned tables in one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        ensure_importable(spark)
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _manifest(self, version: int) -> object:
        return self._path(f"{self.root}/manifests/{version:09d}.json")

    def version(self) -> int:
        """The last published version, 0 for an empty store."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:9]) for n in names if n.endswith(".json") and n[:9].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, by default the last one."""
        version = self.version() if version is None else version
        if not version:
            return Manifest()
        stream = self._fs.open(self._manifest(version))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        m = self.manifest(version)
        if table not in m.schemas:
            raise KeyError(f"no table {table} in version {m.version}")
        schema = StructType.fromJson(m.schemas[table])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/data/{p}") for p in m.parts[table]]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> str:
        """Writes a part that no version names yet; returns its name, to be read and committed."""
        part = f"{uuid.uuid4().hex}/{name}"
        df.write.parquet(f"{self.root}/data/{part}")
        return part

    def read_part(self, part: str) -> DataFrame:
        """The rows of one part."""
        return self.spark.read.parquet(f"{self.root}/data/{part}")

    @contextmanager
    def scratch(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes rows into a folder of the store and reads them back, cut from their lineage; the folder goes at the end."""
        folder = f"{self.root}/scratch/{uuid.uuid4().hex}"

        def kept(df: DataFrame) -> DataFrame:
            at = f"{folder}/{uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)

        try:
            yield kept
        finally:
            self._fs.delete(self._path(folder), True)

    def commit(self, base: Manifest, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, batch: str | None = None, notes: dict | None = None, layout: dict[str, Callable] | None = None, written: dict[str, str] | None = None, keep: bool = False) -> Manifest:
        """Publishes the version after ``base``: whole tables in place of others, and rows added to tables.

        ``layout`` has functions that set how a table's writer partitions it,
        ``written`` parts of ``write`` by table, beside the former ones if ``keep``.
        Raises Conflict if another writer was first; nothing is published then.
        """
        folder, parts, schemas = uuid.uuid4().hex, dict(base.parts), dict(base.schemas)
        for name, part in (written or {}).items():
            parts[name] = [*(parts.get(name, []) if keep else []), part]
            schemas[name] = json.loads(self.read_part(part).schema.json())
        for tables, beside in ((replaced or {}, False), (added or {}, True)):
            for name, df in tables.items():
                writer = (layout or {}).get(name, lambda w: w)(df.write)
                writer.parquet(f"{self.root}/data/{folder}/{name}")
                parts[name] = [*(parts.get(name, []) if beside else []), f"{folder}/{name}"]
                schemas[name] = json.loads(df.schema.json())
        now = Manifest(base.version + 1, parts, schemas, [*base.batches, batch] if batch else base.batches, notes if notes is not None else base.notes)
        try:
            out = self._fs.create(self._manifest(now.version), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise Conflict(f"version {now.version} of {self.root} is taken") from e
            raise
        out.write(bytearray(json.dumps(now.__dict__).encode()))
        out.close()
        return now
