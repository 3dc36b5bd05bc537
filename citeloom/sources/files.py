"""Python data sources: files of a repository, and history logs as batches and streams.

Spark's own listing leaves out names that begin with a dot or an underscore, which
a repository needs (``.gitignore``, ``__init__.py``). Listing happens once on the
driver, and yields names and sizes only; contents are read in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SHA = re.compile(rb"[0-9a-f]{40}\Z")
TASK_BYTES = 32 << 20
READ_BYTES = 1 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]) -> None:
        self.paths = paths


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"].rstrip("/"), int(options.get("maxbytes", 1 << 62))

    def partitions(self) -> list[Files]:
        system, base = _opened(self.root)
        out, size = [[]], 0
        for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or info.size > self.most or "/.git/" in info.path[len(base) :]:
                continue
            if size > TASK_BYTES:
                out.append([])
                size = 0
            out[-1].append((info.path[len(base) + 1 :], info.size))
            size += info.size + 4096
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, base = _opened(self.root)
        for path, size in partition.paths:
            with system.open_input_stream(f"{base}/{path}") as stream:
                yield pa.RecordBatch.from_pydict({"file_path": [path], "length": [size], "content": [stream.read()]}, pa.schema([("file_path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))


class RepositoryFiles(DataSource):
    """``spark.read.format("repository_files").load(root)``: every file under a root; ``maxBytes`` leaves larger ones out."""

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return "file_path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(self.options)


def records(stream, most: int | None) -> Iterator[tuple[str, str, str, str]]:
    """(sha, at, subject, body) of a NUL-delimited log of four fields a record, read in pieces; bad hashes are skipped."""
    held, fields, count, done = b"", [], 0, False
    while not done and (most is None or count < most):
        piece = stream.read(READ_BYTES)
        done = not piece
        *whole, held = (held + piece).split(b"\0")
        if done and (held.strip() or fields):
            whole.append(held)
        for field in whole:
            fields.append(field.strip())
            if len(fields) == 4 or done:  # at the end one field is left
                sha, at, subject, body = fields + [b""] * (4 - len(fields))
                fields = []
                if SHA.match(sha) and (most is None or count < most):
                    count += 1
                    yield tuple(x.decode(errors="replace") for x in (sha, at, subject, body))


class _Log:
    """Logs of a folder, one a repository, each read by one task; ``limit`` counts a log's records."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.limit = int(options["limit"]) if "limit" in options else None

    def names(self) -> list[str]:
        system, base = _opened(self.root)
        found = system.get_file_info(fs.FileSelector(base))
        return sorted(i.base_name for i in found if i.type == fs.FileType.File)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = _opened(self.root)
        for name, _ in partition.paths:
            with system.open_input_stream(f"{base}/{name}") as stream:
                for row in records(stream, self.limit):
                    yield (name, *row)


class _LogReader(_Log, DataSourceReader):
    def partitions(self) -> list[Files]:
        return [Files([(n, 0)]) for n in self.names()] or [Files([])]


class _LogStream(_Log, DataSourceStreamReader):
    """An offset is the last name read: a log that is written later must sort after it."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        names = self.names()
        return {"last": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return [Files([(n, 0)]) for n in self.names() if start["last"] < n <= end["last"]]

    def commit(self, end: dict) -> None:
        pass


class HistoryLog(DataSource):
    """``format("history_log")``: records (log, sha, at, subject, body) of NUL-delimited logs, as a batch or a stream; ``limit`` a log."""

    @classmethod
    def name(cls) -> str:
        return "history_log"

    def schema(self) -> str:
        return "log string, sha string, at string, subject string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositoryFiles)
    spark.dataSource.register(HistoryLog)
