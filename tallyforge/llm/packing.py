"""Token-id output: best-fit-decreasing packing of documents into rows of equal length.

Documents longer than a row are split without loss.  Pieces, longest first, go to the row with the
least room that still holds them; a segment tree over the amounts of room finds it in a
logarithm of the row's length.  A row comes with its ids (padded), the cumulative lengths of its
segments and positions that begin anew with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.stages import give_back

#: Tokens that a task gathers before it packs them; a document may exceed it alone.
POOL = 4 << 20
#: Tokens of a shard, and rows that a task sends on at a time.
SHARD, SENT = 8 << 20, 128
SCHEMA = "shard int, row long, n_tokens int, n_segments int, doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Rooms:
    """Open rows by room left, over a segment tree that finds the least room of at least x."""

    def __init__(self, most: int):
        self.leaves = 1 << int(most).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the least room >= least, and that room."""
        at = least + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (number of the document, offset, size); every token of every document once."""
    pieces = []
    for i, n in enumerate(sizes):
        pieces += [(min(length, n - at), i, at) for at in range(0, n, length)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    rows, rooms = [], Rooms(length)
    for size, i, at in pieces:
        found = rooms.take(size)
        if found is None:
            found = len(rows), length
            rows.append([])
        row, room = found
        rows[row].append((i, at, size))
        if room > size:
            rooms.put(row, room - size)
    return rows


def pack(tokens: DataFrame, length: int = 2048, pad: int = 0, shards: int | None = None) -> DataFrame:
    """Packed rows of ``tokens`` (doc_id long, token_ids: little-endian unsigned 32-bit integers).

    ``ids`` and ``positions`` are rows of ``length`` such integers, behind n_tokens filled with
    ``pad`` and 0; segment k is tokens offsets[k] and on of doc_ids[k], and fills cu_seqlens[k]
    to cu_seqlens[k + 1].  Documents without tokens are in no row.  Rows that repeat are packed
    as often; a null doc_id stays null; an empty table gives no rows.  Documents are dealt by a
    hash of id and tokens (so a repeated id is no hot key unless its tokens repeat too) and
    packed ``POOL`` tokens at a time in the order of ids.  ``shards``, one for every ``SHARD``
    tokens if not given, depends on the tokens alone, so reruns agree and a task's share does not
    grow with the table.  Without ``shards``, ``tokens`` is computed twice.
    """
    n = shards or (tokens.agg(F.sum(F.length("token_ids"))).first()[0] or 0) // (4 * SHARD) + 1
    tokens = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").where("length(token_ids) > 0")
    tokens = tokens.withColumn("h", F.xxhash64("doc_id", "token_ids")).repartition(n, "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal docs, ids, held, made
            rows = best_fit([len(x) for x in ids], length)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            names = ["shard", "row", "n_tokens", "n_segments", "doc_ids", "offsets", "cu_seqlens", "ids", "positions"]
            for first in range(0, len(rows), SENT):  # some rows at a time, so neither side holds a pool twice
                cols: list[list] = [[] for _ in names]
                for segments in rows[first : first + SENT]:
                    flat, place = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
                    ends = np.cumsum([0, *[s for _, _, s in segments]])
                    for (i, at, size), lo in zip(segments, ends.tolist(), strict=False):
                        flat[lo : lo + size] = ids[i][at : at + size]
                        place[lo : lo + size] = np.arange(size)
                    values = (shard, made, int(ends[-1]), len(segments), [docs[i] for i, _, _ in segments], [at for _, at, _ in segments], ends.tolist(), flat.tobytes(), place.tobytes())
                    made += 1
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            docs, ids, held = [], [], 0

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("token_ids"), strict=True):
                x = np.frombuffer(raw.as_py(), "<u4")
                docs.append(doc)
                ids.append(x)
                held += len(x)
                if held >= POOL:
                    yield from close()
        if ids:
            yield from close()

    return tokens.select("doc_id", "token_ids").mapInArrow(give_back(run), SCHEMA)


def save(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, ordered within each file by row."""
    packed.sortWithinPartitions("shard", "row").write.parquet(path)
