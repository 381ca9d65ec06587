"""Intermediate tables in the folder that driver and executors share.

Operators that need a table twice, or that must cut lineage, write Parquet below
``spark.checkpoint.dir``.  The files survive a lost executor, are read with an explicit
schema (so an empty table reads back as an empty table) and go when the session ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Calls within the innermost ``passing`` of this thread.
_made: ContextVar[list["Scratch"] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master without the setting, a folder of this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return _own[app]


class Scratch:
    """Tables of one operator call.

    >>> keep = Scratch(spark, "exact-dedup")
    >>> entries = keep.table(df, "entries")
    >>> keep.drop("entries")
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if (made := _made.get()) is not None:
            made.append(self)

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.parquet(where)
        path, fs = self._path(name)
        fs.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)


@contextmanager
def passing() -> Iterator[None]:
    """Tables that calls of this thread make within go at its end; their results must have been written elsewhere by then.

    Calls of other threads, and of an enclosing ``passing``, keep theirs.
    """
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for call in made:
            call.drop("")
