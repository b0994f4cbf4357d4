"""Markdown trees as a data source of Spark: every .md file, also those whose names begin with _ or a dot, and empty ones.

    spark.dataSource.register(MarkdownTree)
    spark.read.format("markdown").option("parts", 256).load("hdfs:///corpus/docs")

The driver lists folders from the root down only until it has as many as there
are parts, and keeps folders, not files. Each of these folders is walked by
tasks, SHARES of them for each, which read the files whose path falls to their
share; so one folder with a third of all files is read by several tasks. A file
that cannot be read fails the task with its path, unless `errors` is `skip`.
Links that lead nowhere are not listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, body string"
PARTS = 64
SHARES = 4  # tasks for each folder
BATCH_BYTES = 4 << 20


@dataclass
class Share(InputPartition):
    """Files of a folder, with those below it if deep, whose path falls to `share` of `shares`."""

    folder: str
    deep: bool
    share: int
    shares: int


def _opened(root: str):
    from pyarrow import fs

    if "://" not in root:  # a plain path, or file:/ as Spark writes it
        root = "file://" + root.removeprefix("file:")
    files, top = fs.FileSystem.from_uri(root)
    return files, top.rstrip("/")


def _listing(files, folder: str, deep: bool) -> list:
    from pyarrow import fs

    return files.get_file_info(fs.FileSelector(folder, recursive=deep))


class MarkdownReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.parts, self.skip = options["path"], int(options.get("parts", PARTS)), options.get("errors", "fail") == "skip"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, top = _opened(self.root)
        if files.get_file_info(top).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.root}")
        whole, flat = [top], []  # folders to be walked, and those whose own files only are left
        while whole and len(whole) + len(flat) < self.parts:
            below = [i.path for f in whole for i in _listing(files, f, False) if i.type == fs.FileType.Directory]
            flat += whole
            whole = below
        return [Share(f, deep, k, SHARES) for folders, deep in ((flat, False), (whole, True)) for f in sorted(folders) for k in range(SHARES)]

    def _found(self, files, top: str, partition: Share) -> Iterator[tuple]:
        """(path below the root, what the listing says) of the share's files."""
        from pyarrow import fs

        for info in _listing(files, partition.folder, partition.deep):
            if info.type == fs.FileType.Directory or not info.path.endswith(".md"):
                continue
            path = info.path[len(top) + 1 :]
            if zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.shares == partition.share:
                yield path, info

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, top = _opened(self.root)
        paths, bodies, held = [], [], 0
        for path, info in self._found(files, top, partition):
            try:
                with files.open_input_stream(info.path) as f:
                    body = f.read().decode("utf-8", "replace")
            except OSError as e:
                if self.skip:
                    continue
                raise OSError(f"read {path}: {e}") from e
            paths.append(path)
            bodies.append(body)
            held += len(body)
            if held > BATCH_BYTES:
                yield _batch(paths, bodies)
                paths, bodies, held = [], [], 0
        if paths:
            yield _batch(paths, bodies)


def _batch(paths: list[str], bodies: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.string())], names=["path", "body"])


class ListingReader(MarkdownReader):
    """Names, times and sizes, from the same folders and shares; no file is opened. Names that begin with _ or a dot are left out, as by Spark's listing."""

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, top = _opened(self.root)
        rows = [(p, i.mtime_ns // 1_000_000 * 1_000, i.size) for p, i in self._found(files, top, partition) if not any(n.startswith((".", "_")) for n in p.split("/"))]
        if rows:
            paths, modified, size = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(modified, pa.timestamp("us", tz="UTC")), pa.array(size, pa.int64())], names=["path", "modified", "size"])


class MarkdownListing(DataSource):
    """(path, modified, size) of the files that Spark would list, empty ones too, listed by tasks."""

    @classmethod
    def name(cls) -> str:
        return "markdown_listing"

    def schema(self) -> str:
        return "path string, modified timestamp, size long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class MarkdownTree(DataSource):
    """(path, body) of all files below a folder whose name ends in .md; path relative to it, bytes that are no UTF-8 replaced."""

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MarkdownReader(self.options)
