"""Markdown files as rows."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schemas import FILE
from larkspur.session import staged
from larkspur.sources.tree import BATCH_BYTES, MarkdownListing, _opened


FILES = 2_000  # files that a task opens


def relative_path(spark: SparkSession, root: str, at: Column | str) -> Column:
    """The path below root of a file's full path as Spark gives it, with its escapes undone: the one name of a file, however it is read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(at, r"\+", "%2B")), "^file:/+", "file:/")
    return F.substring(plain, F.lit(len(full.replace("file:///", "file:/")) + 1), F.length(plain))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of all files below root whose name ends in .md, path relative to root. Any storage that Spark reads.

    Spark's file listing leaves out names that begin with _ or . and empty files.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("body"))
    return raw.select(relative_path(spark, root, "at").alias("path"), "body")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size) of these files, from the listing: no file is opened.

    Tasks list the folders of storage that Arrow knows; other storage is listed
    by Spark, and a task looks at many files.
    """
    if _known(root):
        spark.dataSource.register(MarkdownListing)
        return spark.read.format("markdown_listing").load(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    rows = raw.select(relative_path(spark, root, "_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.coalesce(max(1, 4 * spark.sparkContext.defaultParallelism))


def _known(root: str) -> bool:
    """Whether Arrow has a file system for a folder."""
    try:
        return bool(_opened(root))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _contents(root: str, bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _opened(root)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            while paths:
                own, found, held = [], [], 0
                while paths and held < BATCH_BYTES:
                    own.append(paths.pop())
                    with files.open_input_stream(f"{top}/{own[-1]}") as f:
                        data = f.read()
                    held += len(data)
                    found.append(data if bodies else hashlib.sha256(data).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(found, pa.binary() if bodies else pa.string())], names=["path", "body" if bodies else "digest"])

    return run


def contents(paths: DataFrame, root: str, bodies: bool = True) -> DataFrame:
    """(path, body) of these files below root, or (path, digest), each opened by the task that has its name; no other file is opened, and no text is stored or shuffled."""
    if not _known(root):
        rows = read_markdown(paths.sparkSession, root).join(paths.select("path"), "path", "left_semi")
        return rows if bodies else rows.select("path", F.sha2("body", 256).alias("digest"))
    dealt = paths.select("path").repartition(paths.count() // FILES + 1)
    if not bodies:
        return dealt.mapInArrow(_contents(root, False), "path string, digest string")
    return dealt.mapInArrow(_contents(root, True), "path string, body binary").select("path", F.col("body").cast("string").alias("body"))


def read_local_markdown(spark: SparkSession, root: str) -> DataFrame:
    """The same for a folder that only the driver has: also takes names that begin with _ or a dot. For small corpora."""
    rows = []
    for folder, _, names in sorted(os.walk(root)):
        for name in sorted(n for n in names if n.endswith(".md")):
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace", newline="") as f:
                rows.append((os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/"), f.read()))
    return spark.createDataFrame(rows, FILE)


def from_documents(documents: DataFrame) -> DataFrame:
    """A table of plain texts (doc_id, text, lang, source) as markdown files: (doc_id, path, body)."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n## "), F.col("lang"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    return documents.select("doc_id", path.alias("path"), body.alias("body"))


def _write(root: str, replace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = _opened(root)
        made = set()

        def same(info, data: bytes) -> bool:
            if info.type != fs.FileType.File or info.size != len(data):
                return False
            with files.open_input_stream(info.path) as f:
                return f.read() == data

        for batch in batches:
            paths = [f"{top}/{p}" for p in batch.column(0).to_pylist()]
            there = files.get_file_info(paths) if replace else [None] * len(paths)
            for at, info, body in zip(paths, there, batch.column(1).to_pylist(), strict=True):
                data = (body or "").encode()
                if info is not None and same(info, data):
                    continue
                folder = at.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(at) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return run


def write_markdown(files: DataFrame, root: str, replace: bool = False) -> int:
    """Write files(path, body) below root, a URI that executors can write to, each from the task that has it; returns how many. With replace, files below root that are not among them go, and those that have not changed are left as they are."""
    spark = files.sparkSession
    written = staged(files.select("path", "body").where("path is not null").mapInArrow(_write(root, replace), "path string"), "written")
    if replace:
        gone = listed(spark, root).join(written, "path", "left_anti")
        gone.select("path").mapInArrow(_remove(root), "path string").count()
    return written.count()


def _remove(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _opened(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files.delete_file(f"{top}/{path}")
            yield batch

    return run
