"""Packs of documents, and asking all of them about keys that they may share.

A pack is some megabytes of texts, compressed, in one row of a table in the shared folder.
Operators that must know which of their keys occur elsewhere send, for each pack, its keys by
bucket in a few bytes each; whoever holds a bucket answers with one code for each key sent, in
the order sent.  So a key costs some bytes in the shuffle, not a row, a key that everybody has
costs one entry a pack, and the answers return to where the text is.  A bucket holds a fixed
amount of keys, so buckets grow with the input; a pack sends rows for the buckets that its keys
fall in, at most one for each of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.stages import give_back
from tallyforge.storage import Scratch

#: Bytes of text from which a pack is closed.
PACK = 4 << 20
U = np.uint64
PACK_SCHEMA = "pack long, n_bytes long, ids binary, nulls binary, sizes binary, body binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    for by in (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)):
        x *= by
        x ^= x >> U(33)
    return x


@dataclass
class Pack:
    """Texts with their ids; where ``nulls`` is set the doc_id is null and the id says nothing."""

    pack: int
    ids: np.ndarray
    nulls: np.ndarray
    texts: list[bytes]

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.nulls)


def build(docs: DataFrame, least: int = PACK) -> DataFrame:
    """Packs of the rows of ``docs`` (doc_id long, text), in the order of its partitions, each of ``least`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, texts, size, n
            nulls = np.array([i is None for i in ids], np.uint8)
            numbers = np.array([i or 0 for i in ids], "<i8")
            cols = [(part << 32) + n, size, numbers.tobytes(), nulls.tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), squeeze(b"".join(texts))]
            ids, texts, size, n = [], [], 0, n + 1
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], names=["pack", "n_bytes", "ids", "nulls", "sizes", "body"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = (t.as_py() or "").encode()
                ids.append(i)
                texts.append(data)
                size += len(data)
                if size >= least:
                    yield close()
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(give_back(run), PACK_SCHEMA)


def stored(docs: DataFrame, keep: Scratch, least: int = PACK) -> tuple[DataFrame, int]:
    """The packs as a table, and the bytes of all texts."""
    packs = keep.table(build(docs, least), "packs")
    return packs, packs.agg(F.sum("n_bytes")).first()[0] or 0


def read(batch: pa.RecordBatch) -> Iterator[tuple[Pack, int]]:
    """The packs of a batch, each with its row's number."""
    for i in range(batch.num_rows):
        sizes = np.frombuffer(batch.column("sizes")[i].as_py(), "<i8")
        body, ends = unsqueeze(batch.column("body")[i].as_py()), np.cumsum(sizes)
        texts = [body[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        nulls = np.frombuffer(batch.column("nulls")[i].as_py(), np.uint8).astype(bool)
        yield Pack(batch.column("pack")[i].as_py(), np.frombuffer(batch.column("ids")[i].as_py(), "<i8"), nulls, texts), i


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n (below 2 ** 31) equal ranges of 64-bit keys each key is in."""
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def cuts_of(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending bucket numbers: each number that occurs, and where its run begins (and the last one ends)."""
    at = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.zeros(0, np.int64)
    return buckets[at], np.append(at, len(buckets))


def low40(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_low40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def ask(packs: DataFrame, n: int, keys_of: Callable[[Pack], tuple[np.ndarray, np.ndarray]], answer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``packs`` with ``codes``: answers of one byte for each key of the pack, in the keys' order.

    keys_of: a pack's distinct keys in order, and an unsigned 32-bit mark for each.  answer: from
    the keys (40 bits of them) and marks of all packs in one of n buckets, unordered, the code of each.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, _ in read(batch):
                keys, marks = keys_of(p)
                used, at = cuts_of(bucket_of(keys, n))
                marks = marks.astype("<u4")
                low = low40(keys)
                cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(used, pa.int32()), "pack": pa.array([p.pack] * len(used), pa.int64()),
                    "keys": pa.array([low[5 * a : 5 * b] for a, b in cut], pa.binary()), "marks": pa.array([squeeze(marks[a:b].tobytes()) for a, b in cut], pa.binary()),
                })

    def reply(table: pa.Table) -> pa.Table:
        keys = [from_low40(x) for x in table.column("keys").to_pylist()]
        marks = [np.frombuffer(unsqueeze(x), "<u4") for x in table.column("marks").to_pylist()]
        codes = answer(np.concatenate(keys), np.concatenate(marks)).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        out = [squeeze(codes[e - len(k) : e].tobytes()) for k, e in zip(keys, ends, strict=True)]
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "codes": pa.array(out, pa.binary())})

    sent = packs.mapInArrow(give_back(send), "bucket int, pack long, keys binary, marks binary")
    got = sent.groupBy("bucket").applyInArrow(reply, "pack long, bucket int, codes binary")
    got = got.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("codes"))
    return packs.join(got.hint("merge"), "pack", "left").withColumn("codes", F.expr("transform(codes, c -> c.codes)"))


def codes_of(batch: pa.RecordBatch, row: int) -> np.ndarray:
    got = batch.column("codes")[row].as_py() or []
    return np.frombuffer(b"".join(unsqueeze(x) for x in got), np.uint8)


def totals(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys, where each distinct key begins in it, and the sum of its marks."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, at, np.add.reduceat(marks[order].astype(np.int64), at) if len(k) else at


def spread(codes: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code of each distinct key (as in ``totals``) at every place of that key."""
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(codes, np.diff(np.append(at, len(order))))
    return out
