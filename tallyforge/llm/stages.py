"""What operators and stages share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


Batches = Iterator[pa.RecordBatch]


def give_back(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``f`` for mapInArrow, after which freed memory returns to the system.

    Python workers are reused, so what one operator's arrays took would otherwise stay with the
    worker through the stages that follow.
    """

    def run(batches: Batches) -> Batches:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_rows(docs: DataFrame, keys: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose doc_id, text length and digest are in ``keys``, each triple once.

    ``digest`` is the column of ``docs`` that ``keys`` (doc_id, n_chars, text_sha256) has as
    text_sha256, so only rows of one doc_id (null ids match null ids) and one text without its
    blanks compete.  Other columns may have any names and stay.
    """
    own_n, own_sha, row, key_id, key_n, key_sha = (free_name(docs, x) for x in ("own_n", "own_sha", "row", "key_id", "key_n", "key_sha"))
    keys = keys.select(F.col("doc_id").alias(key_id), F.col("n_chars").alias(key_n), F.unhex("text_sha256").alias(key_sha)).distinct()
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    own = docs.select("*", size.alias(own_n), F.unhex(digest).alias(own_sha))
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.col(own_n) == F.col(key_n)) & (F.col(own_sha) == F.col(key_sha))
    joined = own.join(keys.hint("merge"), same, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", own_n, own_sha).orderBy(F.xxhash64("text")))
    return joined.select("*", first.alias(row)).where(F.col(row) == 1).select(*docs.columns)
