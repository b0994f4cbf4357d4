"""Session settings that results depend on, and the folder for staged tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "larkspur", **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; options are Spark settings with dots written as underscores twice."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_made: dict[str, list[str]] = {}  # staged tables by application, for release()
_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """The tables that one call has staged, in its own thread, and so may delete: nothing that other code has staged is among them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scope:
        self._token = _scope.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scope.reset(self._token)
        outer = _scope.get()
        if outer is not None:
            outer.paths += self.paths

    def drop(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Delete the tables but for those that `keep` reads; what still reads the others can no longer run."""
        read = keep.inputFiles() if keep is not None else []
        gone = [p for p in self.paths if not any(f"{p.removeprefix('file://').removeprefix('file:')}/" in f for f in read)]
        _drop(spark, gone)
        self.paths = [p for p in self.paths if p not in gone]
        made = _made.get(spark.sparkContext.applicationId, [])
        made[:] = [p for p in made if p not in gone]


def scoped(function):
    """The function's staged tables are a scope of their own, from which `restaged` deletes."""

    @functools.wraps(function)
    def run(*args, **options):
        with Scope():
            return function(*args, **options)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. One of our own only where none is set and the session is a local one, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (own := _scope.get()) is not None:
        own.paths.append(path)
    return path


#: Parquet counts what it holds at least after every hundred rows; a table whose rows have megabytes needs a look at each.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and a lost executor costs a re-read. With LARGE_ROWS as options a task holds few rows, whatever it writes or reads."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def restaged(df: DataFrame, name: str, stay: Sequence[DataFrame] = ()) -> DataFrame:
    """Stage df and delete what the scope has staged before it, which df was made from, but for what `stay` reads."""
    own = _scope.get()
    before = list(own.paths) if own is not None else []
    out = staged(df, name)
    if own is not None:
        read = [f for kept in stay for f in kept.inputFiles()]
        gone = Scope()
        gone.paths = [p for p in before if not any(f"{p.removeprefix('file://').removeprefix('file:')}/" in f for f in read)]
        own.paths = [p for p in own.paths if p not in gone.paths]
        gone.drop(df.sparkSession)
    return out


def few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it is counted and has `most` rows at most; a table that is larger is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession) -> int:
    """Delete the staged tables of this application; returns how many. Results that still read them must have been written or collected."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    _drop(spark, paths)
    return len(paths)
