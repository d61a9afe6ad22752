"""Registry of named queries with their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from textmill.operators.ann import VectorIndex
from textmill.operators.lexical_index import LexicalIndex
from textmill.shipping import ensure_importable
from textmill.storage import Conflict, Store, checkpointed, shared_dir

#: Raised when what is stored for queries changes its form: older folders are then left alone.
FORMAT = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Input tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ensure_importable(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self.pinned: dict[str, DataFrame] = {}

    def checkpointed(self, df: DataFrame) -> DataFrame:
        """The table cut from its lineage, in the session's checkpoint folder; a folder of this machine only where none is set."""
        return checkpointed(df)

    def state(self, *tables: str) -> str:
        """A digest of the paths, sizes and times of tables' files: what is stored of other contents has another name."""
        jvm, conf, files = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), []
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{table}.parquet")
            files += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in path.getFileSystem(conf).listStatus(path))
        return hashlib.sha256(repr((FORMAT, files)).encode()).hexdigest()[:24]

    def _stored(self, kind: type, name: str, table: str, rows: DataFrame | None = None) -> object:
        """The index of a table in the shared folder; built by the first query that asks for it."""
        index = kind(Store(self.spark, f"{shared_dir(self.spark)}/{name}-{self.state(table)}"))
        if not index.store.version():
            try:
                index.rebuild(getattr(self, table) if rows is None else rows)
            except Conflict:  # another session has built it meanwhile
                pass
        return index

    @cached_property
    def index(self) -> LexicalIndex:
        """The stored inverted index of ``documents``."""
        return self._stored(LexicalIndex, "lexical", "documents")

    def stored_index(self, name: str, table: str, rows: DataFrame) -> LexicalIndex:
        """The stored inverted index of rows that derive from a table."""
        return self._stored(LexicalIndex, name, table, rows)

    @cached_property
    def vector_index(self) -> VectorIndex:
        """The stored vector index of ``embeddings``."""
        return self._stored(VectorIndex, "vectors", "embeddings")

    def pin(self, name: str, df: DataFrame) -> None:
        """Keeps a table that one plan derives several others from, so that it is made once."""
        self.pinned[name] = checkpointed(df)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a plan over ``Tables`` under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
