"""Python data sources: corpora of files and append-only JSON-lines logs, in batches and as streams, and a log sink.

``corpus_files`` reads a folder of texts, a file a row; what can't be read is a
row with its problem. ``jsonl_log`` reads lines with the file and place they
come from; damaged lines are rows with a problem too. As streams both resume
from their offsets. Written to, ``jsonl_log`` stages each task's rows in a file
of its own and publishes them by renaming once all tasks have ended, so a task
that dies, or a job, leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Suffixes of texts, and names that are no documents.
TEXT_SUFFIXES = ("md", "markdown", "txt", "rst", "csv", "log")
SKIPPED_STEMS = ("readme", "index", "说明")
#: Bytes of files in one partition, about, and of a line at most that a reader holds.
PART_BYTES, BLOCK = 32 << 20, 1 << 20

CORPUS = "name string, text string, problem string"
LOG = "file string, place long, record string, problem string"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _store(url: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in url:
        url = "file://" + posixpath.abspath(url[len("file:") :] if url.startswith("file:") else url)
    return pafs.FileSystem.from_uri(url)


def _files(url: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files of a folder that don't start with a dot or underscore, by name."""
    fs, at = _store(url)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True))
    return sorted((f.path, f.size, int(f.mtime_ns or 0)) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass
class Files(InputPartition):
    """Files of one partition, each with the bytes that count."""

    parts: list[tuple[str, int, int]]


def _dealt(files: list[tuple[str, int, int]]) -> list[Files]:
    """Files or byte ranges in partitions of about ``PART_BYTES``."""
    out: list[Files] = []
    full = PART_BYTES
    for path, begin, end in files:
        if full >= PART_BYTES:
            out.append(Files([]))
            full = 0
        out[-1].parts.append((path, begin, end))
        full += end - begin
    return out or [Files([])]


def _document(fs: pafs.FileSystem, path: str) -> tuple[str, str | None, str | None]:
    """(name, text, problem) of one file; never raises for what a file is."""
    name = posixpath.basename(path)
    stem, _, suffix = name.lower().rpartition(".")
    if suffix not in TEXT_SUFFIXES or not stem:
        return name, None, "unknown suffix"
    if stem in SKIPPED_STEMS:
        return name, None, "not a document"
    try:
        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        return (name, raw.decode("utf-8"), None) if raw else (name, None, "empty")
    except UnicodeDecodeError as e:
        return name, None, f"no UTF-8 at byte {e.start}"
    except OSError as e:
        return name, None, f"unreadable: {type(e).__name__}"


class _CorpusReader(DataSourceReader):
    def __init__(self, url: str) -> None:
        self.url, self.names = url, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Names that are asked for are looked up; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} & (self.names if self.names is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value) & (self.names if self.names is not None else set(f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files by name in partitions of bounded size."""
        return _dealt([(p, 0, n) for p, n, _ in _files(self.url) if self.names is None or posixpath.basename(p) in self.names])

    def read(self, partition: Files) -> Iterator[tuple]:
        """A row per file."""
        fs = _store(self.url)[0]
        for path, _, _ in partition.parts:
            yield _document(fs, path)


class _CorpusStream(DataSourceStreamReader):
    """An offset is the last (time, name) that has been read: files are taken in the order in which they have appeared."""

    def __init__(self, url: str) -> None:
        self.url = url

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((t, p) for p, _, t in _files(self.url)), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _dealt([(p, 0, n) for p, n, t in _files(self.url) if low < (t, p) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        fs = _store(self.url)[0]
        for path, _, _ in partition.parts:
            yield _document(fs, path)


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return CORPUS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CorpusReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _CorpusStream(self.options["path"])


def _lines(fs: pafs.FileSystem, path: str, begin: int, end: int) -> Iterator[tuple]:
    """Rows of the lines that begin in a range of bytes; the range ends behind a line."""
    name, at = posixpath.basename(path), begin
    with fs.open_input_file(path) as f:
        rest = b""
        f.seek(begin)
        while at + len(rest) < end or rest:
            block = f.read(min(BLOCK, max(0, end - at - len(rest))))
            rest += block
            lines = rest.split(b"\n")
            rest = lines.pop()
            if not block and rest:  # the last line of a file that ends without a line feed
                lines, rest = [rest], b""
            for raw in lines:
                place, at = at, at + len(raw) + 1
                if raw.strip():
                    yield name, place, *_record(raw)
            if not block:
                break


def _record(raw: bytes) -> tuple[str | None, str | None]:
    try:
        text = raw.decode("utf-8")
        return (text, None) if isinstance(json.loads(text), dict) else (None, "no object")
    except UnicodeDecodeError:
        return None, "no UTF-8"
    except ValueError:
        return None, "no JSON"


class _LogReader(DataSourceReader):
    def __init__(self, url: str) -> None:
        self.url = url

    def partitions(self) -> Sequence[InputPartition]:
        return _dealt([(p, 0, n) for p, n, _ in _files(self.url)])

    def read(self, partition: Files) -> Iterator[tuple]:
        fs = _store(self.url)[0]
        for path, begin, end in partition.parts:
            yield from _lines(fs, path, begin, end)


class _LogStream(DataSourceStreamReader):
    """An offset is the bytes of whole lines that have been read of each file; a line that is still being written waits."""

    def __init__(self, url: str) -> None:
        self.url = url

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs = _store(self.url)[0]
        return {p: self._whole(fs, p, n) for p, n, _ in _files(self.url)}

    @staticmethod
    def _whole(fs: pafs.FileSystem, path: str, size: int) -> int:
        """Bytes up to the last line feed."""
        with fs.open_input_file(path) as f:
            end = size
            while end:
                begin = max(0, end - BLOCK)
                at = f.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _dealt([(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)])

    def read(self, partition: Files) -> Iterator[tuple]:
        fs = _store(self.url)[0]
        for path, begin, end in partition.parts:
            yield from _lines(fs, path, begin, end)


@dataclass
class Staged(WriterCommitMessage):
    """A task's file, not yet visible, and its rows."""

    path: str | None
    rows: int


class _LogWriter(DataSourceWriter):
    def __init__(self, url: str, schema: StructType, overwrite: bool) -> None:
        self.url, self.names, self.overwrite, self.job = url, schema.names, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """Stages the rows of a task: an object a line, nulls left out."""
        fs, at = _store(self.url)
        path, n, out = f"{at}/_staged/{self.job}/{uuid.uuid4().hex}.jsonl", 0, None
        for row in iterator:
            if out is None:
                fs.create_dir(posixpath.dirname(path), recursive=True)
                out = fs.open_output_stream(path, compression=None)
            out.write(json.dumps({k: v for k, v in zip(self.names, row) if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
            n += 1
        if out is not None:
            out.flush()
            out.close()
        return Staged(path if n else None, n)

    def _publish(self, messages: list[WriterCommitMessage | None], prefix: str) -> None:
        fs, at = _store(self.url)
        fs.create_dir(at, recursive=True)
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            fs.move(m.path, f"{at}/{prefix}-{i:06d}.jsonl")
        self._clear(fs, at)

    def _clear(self, fs: pafs.FileSystem, at: str) -> None:
        if fs.get_file_info(f"{at}/_staged/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/_staged/{self.job}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Makes all tasks' rows visible; with overwrite, those of before go first."""
        if self.overwrite:
            fs = _store(self.url)[0]
            for path, _, _ in _files(self.url):
                fs.delete_file(path)
        self._publish(messages, f"part-{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Deletes what has been staged."""
        self._clear(*_store(self.url))


class _LogStreamWriter(_LogWriter, DataSourceStreamWriter):
    """Files are named by the batch, so a batch that is written again replaces itself."""

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        fs = _store(self.url)[0]
        for path, _, _ in _files(self.url):
            if posixpath.basename(path).startswith(f"batch{batchId:09d}-"):
                fs.delete_file(path)
        self._publish(messages, f"batch{batchId:09d}")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._clear(*_store(self.url))


class JsonlLog(DataSource):
    """``spark.read.format("jsonl_log")``, ``readStream``, ``write`` and ``writeStream`` of one folder of JSON lines."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _LogStream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _LogStreamWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session. Pushing filters to them is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFiles)
    spark.dataSource.register(JsonlLog)
