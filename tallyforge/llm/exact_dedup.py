"""Exact dedup by a log-structured merge index of digests.

Mapping tasks fill a memtable of digests and flush it as sorted runs, copies already merged.
Runs are dealt by digest; each index shard keeps them with a Bloom filter per run and compacts
them: entries that hit no other run's filter pass as they are, the others are merged, and the
best identifier and the number of rows survive.  The bytes of equal digests are then compared;
where one digest stands for several texts, the texts themselves form the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.stages import give_back
from tallyforge.storage import Scratch

#: Fixed: the characters that are deleted before texts are compared.
BLANK = b" \t\n\x0b\x0c\r"
BLANK_PATTERN = "[\\x20\\x09-\\x0D]+"
#: Entries of a memtable, runs that a shard gathers before it compacts, bits of filter per entry.
MEMTABLE, FANOUT, FILTER_BITS = 65_536, 8, 10
_COLS = ("digest", "n_chars", "doc_id", "n_rows")
_RUN = "digest binary, n_chars long, doc_id long, n_rows long"


class Run:
    """Digests in order, each once, with the longest and then smallest row and the count."""

    def __init__(self, words: np.ndarray, n_chars: np.ndarray, none: np.ndarray, doc_id: np.ndarray, n_rows: np.ndarray):
        self.words, self.n_chars, self.none, self.doc_id, self.n_rows = words, n_chars, none, doc_id, n_rows
        self.bits = max(64, FILTER_BITS * len(words))
        self.filter = np.zeros(self.bits // 8 + 1, np.uint8)
        for at in self._places(words):
            np.bitwise_or.at(self.filter, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def _places(self, words: np.ndarray) -> list[np.ndarray]:
        return [((words[:, 0] + np.uint64(k) * (words[:, -1] | np.uint64(1))) % np.uint64(self.bits)).astype(np.int64) for k in range(1, 6)]

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), bool)
        for at in self._places(words):
            out &= (self.filter[at >> 3] >> (at & 7)) & 1 == 1
        return out

    def take(self, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x[mask] for x in (self.words, self.n_chars, self.none, self.doc_id, self.n_rows))

    @classmethod
    def sorted(cls, words: np.ndarray, n_chars: np.ndarray, none: np.ndarray, doc_id: np.ndarray, n_rows: np.ndarray) -> "Run":
        order = np.lexsort((doc_id, none, -n_chars, *words.T[::-1]))
        words = words[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        return cls(words[at], n_chars[order][at], none[order][at], doc_id[order][at], np.add.reduceat(n_rows[order], at) if len(at) else n_rows[:0])

    def batch(self, width: int) -> pa.RecordBatch:
        raw = np.ascontiguousarray(self.words.astype(">u8")).tobytes()
        step = self.words.shape[1] * 8
        digests = [raw[i : i + width] for i in range(0, len(raw), step)]
        return pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "n_chars": self.n_chars, "doc_id": pa.array(self.doc_id, mask=self.none), "n_rows": self.n_rows})


class Index:
    """A memtable and the runs that it has flushed; ``compact`` leaves one run."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.runs = 0, []

    def add(self, batch: pa.RecordBatch) -> Run | None:
        width = max((len(x) for x in batch.column("digest").to_pylist()), default=1)
        padded = b"".join(x.as_py().ljust(-(-width // 8) * 8, b"\0") for x in batch.column("digest"))
        words = np.frombuffer(padded, ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
        n_chars, doc_id, n_rows = (np.asarray(batch.column(c).fill_null(0)).astype(np.int64) for c in _COLS[1:])
        self.held.append((words, n_chars, np.asarray(batch.column("doc_id").is_null()), doc_id, n_rows))
        self.size += batch.num_rows
        return self.flush() if self.size >= MEMTABLE else None

    def flush(self) -> Run | None:
        if not self.size:
            return None
        run = Run.sorted(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.size = [], 0
        self.runs.append(run)
        return run

    def compact(self) -> None:
        alone, hits = [], []
        for run in self.runs:
            hit = np.zeros(len(run.words), bool)
            for other in self.runs:
                if other is not run:
                    hit |= other.may_hold(run.words)
            alone.append(run.take(~hit))
            hits.append(run.take(hit))
        merged = Run.sorted(*(np.concatenate(x) for x in zip(*hits, strict=True)))
        alone.append(merged.take(np.ones(len(merged.words), bool)))
        self.runs = [Run.sorted(*(np.concatenate(x) for x in zip(*alone, strict=True)))]


def _flush(width: int, compact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        for batch in batches:
            if batch.num_rows and index.add(batch):
                if not compact:
                    yield index.runs.pop().batch(width)
                elif len(index.runs) >= FANOUT:
                    index.compact()
        index.flush()
        if compact and len(index.runs) > 1:
            index.compact()
        for r in index.runs:
            yield r.batch(width)

    return run


def _entries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            shas = [hashlib.sha256(x.encode().translate(None, BLANK)).digest() for x in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                "sha": pa.array(shas, pa.binary()), "digest": pa.array([x[:width] for x in shas], pa.binary()), "n_rows": pa.array([1] * len(texts), pa.int64()),
            })

    return run


def text_sha256(text: str) -> Column:
    """The digest that ``exact_dedup`` returns, of a column of texts."""
    return F.sha2(plain_text(text), 256)


def plain_text(text: str) -> Column:
    """A text without its blanks, which are compared; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_PATTERN, "")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chars`` of each row of ``docs``.

    Texts are equal when identical without the characters of ``BLANK_PATTERN``; null is empty.  The row
    with the most code points, then the smallest doc_id (null last), stays.  Rows that repeat
    doc_id and length of the row that stays are all marked kept; each counts in group_size.
    Only doc_id (an integer) and text are read.  An empty table gives no rows.  A small
    ``digest_bytes`` makes digests collide, for tests.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "exact-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the digest in Python costs less than a pattern and a digest in the JVM
    entries = keep.table(docs.mapInArrow(give_back(_entries(digest_bytes)), "doc_id long, n_chars long, sha binary, digest binary, n_rows long"), "entries")
    runs = entries.select(*_COLS).mapInArrow(give_back(_flush(digest_bytes, False)), _RUN)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = runs.repartition(n, "digest").mapInArrow(give_back(_flush(digest_bytes, True)), _RUN).where("n_rows > 1")
    hits = keep.table(index.select("digest", F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.col("n_rows").alias("group_size")), "hits")

    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), plain_text("text").alias("plain"))
    texts = texts.withColumn("digest", F.expr(f"substring(unhex(sha2(plain, 256)), 1, {digest_bytes})"))
    # copies merge before the shuffle, so a text that fills a third of the rows is one row a task
    variants = texts.groupBy("digest", "plain").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
    clash = keep.table(variants.where("texts > 1").select("digest"), "clash")

    out = entries.select("doc_id", "n_chars", "sha", "digest").join(hits, "digest", "left")
    if not clash.isEmpty():
        best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
        texts = texts.join(clash, "digest", "left_semi")
        groups = texts.groupBy("digest", "plain").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
        groups = groups.select("digest", "plain", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size")
        again = texts.join(groups, ["digest", "plain"]).withColumn("sha", F.unhex(F.sha2("plain", 256)))
        out = out.join(clash, "digest", "left_anti").unionByName(again.drop("plain"))
    one = F.col("group_size").isNull()
    kept = one | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    return out.select(
        "doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars",
    )
