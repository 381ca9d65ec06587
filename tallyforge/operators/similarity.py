"""Pairs of alike texts by the ratio of matching blocks (difflib)."""

from __future__ import annotations

import difflib
import functools
import heapq
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.storage import Scratch


#: Characters of a gram at most.
GRAM = 6
#: Classes of characters whose counts bound a ratio from above, and how many of them come first.
CLASSES, FEW = 64, 8
#: Texts of a chunk, and its bytes of text; a text meets whole chunks.
CHUNK, CHUNK_BYTES = 1 << 15, 32 << 20
#: Texts of end a that are bounded at once, and pairs that are kept before they are compared.
CELL, PAIRS = 16, 1 << 18


@F.pandas_udf(T.StructType().add("counts", T.BinaryType()).add("packed", T.BinaryType()))
def _packed(text: pd.Series) -> pd.DataFrame:
    """How many characters of each class (code point modulo ``CLASSES``) a text has, and the text compressed."""

    def of(x: str) -> tuple[bytes, bytes]:
        counts = np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES, minlength=CLASSES)
        # counts that are cut differ by no more than whole ones
        return np.minimum(counts, 32767).astype("<i2").tobytes(), zlib.compress(x.encode("utf-8", "surrogatepass"), 1)

    return pd.DataFrame([of(x) for x in text], columns=["counts", "packed"])


def _gram_bits(text: str, size: int, bits: int) -> np.ndarray:
    """Which of ``bits`` bits the grams of a text fall on."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    g = np.zeros(max(0, len(c) - size + 1), np.uint64)
    for k in range(size):
        g = (g + c[k : k + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
    on = np.zeros(bits, bool)
    on[((g >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)] = True
    return np.packbits(on).view(np.uint64)


#: Runs of rare characters that are looked up; a second text with a longer one is left to difflib's own search.
RUN = 32


class _Matched:
    """difflib's ratios of first texts to one second text, of the same stretches.

    difflib leaves out characters that make more than a hundredth of a second text of 200 or more.  A stretch starts from the
    longest run of other characters that both have, the leftmost one in the first text, then in the second, and is
    carried on both ways.  So it's enough to look up the runs, by length, instead of going over all pairs of places.
    """

    def __init__(self, b: str):
        self.b, counts = b, Counter(b)
        rare = [c for c, n in counts.items() if len(b) < 200 or n <= len(b) // 100 + 1]
        self.runs = re.compile(f"[{''.join(map(re.escape, rare))}]+") if rare else None
        found = [(m.start(), m[0]) for m in self.runs.finditer(b)] if rare else []
        self.top, self.whole, self.places = max((len(x) for _, x in found), default=0), None, {}
        if self.top > RUN:
            self.whole = difflib.SequenceMatcher(None)
            self.whole.set_seq2(b)
            return
        for at, run in found:
            for k in range(len(run)):
                for to in range(k + 1, len(run) + 1):
                    self.places.setdefault(run[k:to], []).append(at + k)

    def _first(self, a: str) -> None:
        self.a = a
        if self.whole:
            self.whole.set_seq1(a)
            return
        self.starts: list[list[tuple[int, list[int]]]] = [[] for _ in range(self.top + 1)]
        for m in self.runs.finditer(a) if self.runs else ():
            at, run = m.start(), m[0]
            for k in range(len(run)):
                for n in range(1, min(self.top, len(run) - k) + 1):
                    if (there := self.places.get(run[k : k + n])) is None:
                        break
                    self.starts[n].append((at + k, there))

    def _longest(self, a_from: int, a_to: int, b_from: int, b_to: int, top: int) -> tuple[int, int, int, int]:
        """Place in both and length, as ``find_longest_match`` has it, and the length of the run."""
        if self.whole:
            return *self.whole.find_longest_match(a_from, a_to, b_from, b_to), top
        a, b, i, j, n = self.a, self.b, a_from, b_from, 0
        for size in range(min(top, a_to - a_from, b_to - b_from), 0, -1):
            starts = self.starts[size]
            for k in range(bisect_left(starts, a_from, key=itemgetter(0)), len(starts)):
                at, there = starts[k]
                if at + size > a_to:
                    break
                if (m := bisect_left(there, b_from)) < len(there) and there[m] + size <= b_to:
                    i, j, n = at, there[m], size
                    break
            if n:
                break
        size, end_a, end_b = n, i + n, j + n
        while end_a + 64 <= a_to and end_b + 64 <= b_to and a[end_a : end_a + 64] == b[end_b : end_b + 64]:
            end_a, end_b = end_a + 64, end_b + 64
        while end_a < a_to and end_b < b_to and a[end_a] == b[end_b]:
            end_a, end_b = end_a + 1, end_b + 1
        while i - 64 >= a_from and j - 64 >= b_from and a[i - 64 : i] == b[j - 64 : j]:
            i, j = i - 64, j - 64
        while i > a_from and j > b_from and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        return i, j, end_a - i, size

    def ratio(self, a: str, least: float) -> float | None:
        """Rounded, or none below ``least``: once the parts still to be matched can't make up for what is lost."""
        n_a, n_b = len(a), len(self.b)
        if not n_a + n_b:
            return 1.0
        self._first(a)
        reach, parts = min(n_a, n_b), [(-min(n_a, n_b), 0, n_a, 0, n_b, self.top)]
        # parts don't depend on one another, so the largest come first
        while parts:
            if round(2.0 * reach / (n_a + n_b), 4) < least:
                return None
            most, a_from, a_to, b_from, b_to, top = heapq.heappop(parts)
            i, j, n, top = self._longest(a_from, a_to, b_from, b_to, top)
            reach += most + n
            for part in ((a_from, i, b_from, j), (i + n, a_to, j + n, b_to)) if n else ():
                if more := min(part[1] - part[0], part[3] - part[2]):
                    reach += more
                    heapq.heappush(parts, (-more, *part, top))
        return r if (r := round(2.0 * reach / (n_a + n_b), 4)) >= least else None


class _Texts:
    """The rows of one end of a cell by length; their texts are unpacked as they are asked for."""

    def __init__(self, t: pa.Table, end: str, size: int, bits: int):
        at = np.flatnonzero(t["end"].to_numpy() == end)
        n = t["n"].to_numpy()[at]
        order = np.argsort(n, kind="stable")
        self.at, self.n, self.packed = at[order], n[order], t["packed"]
        self.ids, self.rank = t["id"].take(pa.array(self.at)), t["rank"].take(pa.array(self.at)).to_numpy()
        self.counts = np.frombuffer(b"".join(t["counts"].take(pa.array(self.at)).to_pylist()), "<i2").reshape(-1, CLASSES)
        self.size, self.bits = size, bits
        self.grams, self.known = np.zeros((len(at), bits // 64), np.uint64), np.zeros(len(at), bool)
        self.text = functools.lru_cache(256)(self._text)

    def _text(self, k: int) -> str:
        return zlib.decompress(self.packed[int(self.at[k])].as_py()).decode("utf-8", "surrogatepass")

    def bits_of(self, ks: np.ndarray) -> np.ndarray:
        for k in np.unique(ks[~self.known[ks]]).tolist():
            self.grams[k], self.known[k] = _gram_bits(self.text(k), self.size, self.bits), True
        return self.grams[ks]


def _bounded(a: _Texts, b: _Texts, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that may reach ``least``.

    At most ``apart`` characters have no match, and each spoils a count of one character and 2 * size - 1 of grams.
    Counts are added up for a few classes, those that vary most, then for all, then bits of grams.
    """
    share = 1 - least + 1e-4
    few = np.argsort(-b.counts.astype(np.float64).var(0), kind="stable")[:FEW]
    few_a, few_b = (np.ascontiguousarray(x.counts[:, few].T.astype(np.int32)) for x in (a, b))
    n_a, n_b = a.n.astype(np.int32), b.n.astype(np.int32)
    low, high = np.searchsorted(n_b, a.n * (1 - share) / (1 + share) - 1), np.searchsorted(n_b, a.n * (1 + share) / (1 - share) + 1 if share < 1 else np.full(len(a.n), np.inf), "right")
    for at in range(0, len(n_a), CELL):
        to = min(at + CELL, len(n_a))
        lo, hi = int(low[at]), int(high[to - 1])
        if lo >= hi:
            continue
        apart = np.floor(share * (n_a[at:to, None] + n_b[lo:hi])).astype(np.int32)
        off = np.zeros(apart.shape, np.int32)
        for x, y in zip(few_a, few_b, strict=True):
            off += np.abs(y[lo:hi] - x[at:to, None])
        i, j = np.nonzero(off <= apart)
        apart, i, j = apart[i, j], i + at, j + lo
        for k in range(0, len(i), 1 << 14):
            i_, j_, most = (x[k : k + (1 << 14)] for x in (i, j, apart))
            kept = a.rank[i_] < b.rank[j_]
            i_, j_, most = i_[kept], j_[kept], most[kept]
            kept = np.abs(a.counts[i_].astype(np.int32) - b.counts[j_]).sum(1) <= most
            i_, j_, most = i_[kept], j_[kept], most[kept]
            step = max(1, (4 << 20) // a.bits)
            for m in range(0, len(i_), step):
                x, y = i_[m : m + step], j_[m : m + step]
                kept = np.bitwise_count(a.bits_of(x) ^ b.bits_of(y)).sum(1, dtype=np.int64) <= (2 * a.size - 1) * most[m : m + step].astype(np.int64)
                if kept.any():
                    yield x[kept], y[kept]


def _compared(least: float):
    """Pairs of a cell with their ratios; a second text is indexed once for all its first ones."""

    def run(t: pa.Table) -> pa.Table:
        kind, out = t.schema.field("id").type, []
        ends, longest = set(t["end"].unique().to_pylist()), max(1, pc.max(t["n"]).as_py())
        if len(ends) == 2:
            size = min(GRAM, max(1, math.floor(0.25 / (1 - least + 1e-4))))
            a, b = (_Texts(t, end, size, 64 * max(4, -(-4 * longest // 64))) for end in "ab")
            held, n = [], 0
            for pair in chain(_bounded(a, b, least), [None]):
                if pair is not None:
                    held.append(pair)
                    n += len(pair[0])
                if held and (pair is None or n >= PAIRS):
                    i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                    out += _alike(a, b, i, j, least)
                    held, n = [], 0
        i, j, r = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        no = pa.array([], kind)
        return pa.table({"id_a": a.ids.take(pa.array(i)) if out else no, "id_b": b.ids.take(pa.array(j)) if out else no, "ratio": pa.array(r, pa.float64())})

    return run


def _alike(a: _Texts, b: _Texts, i: np.ndarray, j: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    found, matched, last = [], None, None
    order = np.lexsort((i, j))
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        first, second = a.text(x), b.text(y)
        if first == second:
            found.append((x, y, 1.0))
            continue
        if last != y:
            matched, last = _Matched(second), y
        if (r := matched.ratio(first, least)) is not None:
            found.append((x, y, r))
    return found


def near_classes(texts: DataFrame, least: float, block: str | None = None, side: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text) as ``class_id, id`` and pairs of classes as ``id_a, id_b, ratio``; what ``near_pairs`` has is their join.

    A class is the rows of one block, side and text, named by its least id, so copies are compared once; without
    sides each row is its own.  Every text with its block meets all texts of like length: the texts of a band of
    lengths are dealt to chunks, and a task has a chunk of end a and one of end b with the chunks of the two next bands
    beside it.  Texts go there compressed, once for each such chunk of the other end, and no pair leaves a task before
    it is compared.  Disk grows with the texts until a band has more than ``CHUNK`` rows or ``CHUNK_BYTES``, then with
    the number of its chunks too; how often texts meet grows with the square of a band's texts.
    """
    spark = texts.sparkSession
    keep = Scratch(spark, "near-pairs")
    low = least - 1e-4
    step = (2 - low) / low + 1e-9
    rank = F.col(side) if side else F.col("id")
    rows = texts.where(F.col("text").isNotNull() & rank.isNotNull()).select("id", "text", (F.col(block) if block else F.lit(None)).cast("string").alias("b"), rank.alias("rank"))
    key = F.concat(F.to_json(F.struct("b", F.col("rank").cast("string").alias("rank"))), F.sha2("text", 256))
    band = F.floor(F.log(F.greatest(F.length("text"), F.lit(1)).cast("double")) / F.log(F.lit(step))).cast("int")
    keyed = keep.table(rows.select("id", "b", "rank", F.length("text").cast("long").alias("n"), F.octet_length("text").alias("bytes"), band.alias("band"), F.unhex(F.sha2(key, 256)).alias("key")), "keyed")
    members = keep.table(keyed.groupBy("key").agg(F.min("id").alias("class_id")).join(keyed.select("key", "id"), "key").select("class_id", "id"), "members")
    # ids are unique, so a class's own row is the one of its name
    kept = keep.table(keyed.drop("key").join(members.where("class_id = id").select("id"), "id"), "firsts")
    own = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int")
    parts = kept.groupBy("b", "band").agg(own.alias("parts"))
    # end a of a band meets as many chunks of end b as the largest of three bands has
    three = parts.select("b", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), "parts").groupBy("b", "band").agg(F.max("parts").alias("parts_b"))
    both = parts.withColumnRenamed("parts", "parts_a").join(three.withColumnsRenamed({"b": "t_b", "band": "t_band"}), F.col("b").eqNullSafe(F.col("t_b")) & (F.col("band") == F.col("t_band")))
    both = both.select(F.col("b").alias("p_b"), F.col("band").alias("p_band"), "parts_a", "parts_b")
    first, last = kept.agg(F.min("rank"), F.max("rank")).first()
    ends = []
    for end in "ab":
        met = kept.where(F.col("rank") < last if end == "a" else F.col("rank") > first)
        met = met.withColumn("at", F.col("band") if end == "a" else F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
        met = met.join(F.broadcast(both), F.col("b").eqNullSafe(F.col("p_b")) & (F.col("at") == F.col("p_band")))
        mine, others = ("parts_a", "parts_b") if end == "a" else ("parts_b", "parts_a")
        met = met.withColumn("mine", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        place = ("mine", "other") if end == "a" else ("other", "mine")
        cell = F.to_json(F.array(F.col("b").cast("string"), *[F.col(c).cast("string") for c in ("at", *place)]), {"ignoreNullFields": "false"})
        ends.append(met.select("id", F.struct(cell.alias("cell"), F.lit(end).alias("end"), "rank", "n").alias("place")))
    kind = texts.schema["id"].dataType.simpleString()
    # a row's places come together, so its text is shuffled once before it goes to them
    places = ends[0].unionByName(ends[1]).groupBy("id").agg(F.collect_list("place").alias("places"))
    sent = rows.select("id", _packed("text").alias("p")).join(places, "id").select("id", F.explode("places").alias("x"), "p.counts", "p.packed").select("x.*", "id", "counts", "packed")
    # a cell's work is not as its bytes are, so small parts are not merged
    sent = sent.repartition(16 * max(1, spark.sparkContext.defaultParallelism), "cell")
    return members, sent.groupBy("cell").applyInArrow(_compared(least), f"id_a {kind}, id_b {kind}, ratio double")


def near_pairs(texts: DataFrame, least: float, block: str | None = None, side: str | None = None) -> DataFrame:
    """``id_a, id_b, ratio`` of pairs of rows (id, text) with ratio >= least; ids are unique, null texts are in no pair.

    ``block``: only rows of one value meet; ``side``: only rows of different values are pairs, null being none.  The ratio is not
    the same both ways, so the row of the lesser side is the first text, or that of the lesser id where there are no sides.
    Rows of one text are each a pair here; ``near_classes`` keeps them together.
    """
    members, found = near_classes(texts, least, block, side)
    for end in "ab":
        found = found.withColumnRenamed(f"id_{end}", "class_id").join(members.withColumnRenamed("id", f"id_{end}"), "class_id").drop("class_id")
    return found.select("id_a", "id_b", "ratio")


def holding_pairs(docs: DataFrame, items: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, item_id`` of each row of ``docs`` whose text holds the text of an item.

    Cut at spaces, all but the first and the last piece of an item are whole pieces of a text
    that holds it.  So the pieces from the second on, ``width`` of them, are looked up among the
    runs of pieces of all texts, and only rows that share them are compared.  Items too short for
    that are compared with every text.  Null texts hold nothing and are held by nothing; equal
    rows of ``items`` count once.
    """
    items = items.where("text is not null").select("item_id", F.col("text").alias("item")).distinct()
    cut = F.split("item", " ")
    long_ = items.where(F.size(cut) >= width + 2).withColumn("key", F.concat_ws(" ", F.slice(cut, 2, width)))
    short = items.where(F.size(cut) < width + 2)
    texts = docs.where("text is not null").select("doc_id", "text")
    pieces = F.col("pieces")
    runs = F.transform(F.sequence(F.lit(1), F.size(pieces) - (width - 1)), lambda k: F.concat_ws(" ", F.slice(pieces, k, F.lit(width))))
    keys = texts.select("doc_id", F.split("text", " ").alias("pieces")).where(F.size(pieces) >= width).select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))
    near = keys.join(long_, "key").select(F.col("doc_id").alias("near_id"), "item_id", "item").distinct()
    found = texts.join(near, F.col("doc_id").eqNullSafe(F.col("near_id"))).where(F.contains("text", "item"))
    rest = texts.join(short, F.contains("text", "item"))
    return found.select("doc_id", "item_id").unionAll(rest.select("doc_id", "item_id"))
