"""Document fingerprints by locally consistent parsing.

Code points are the symbols of level 0.  At each level runs of a symbol become one symbol, and
deterministic coin tossing relabels each symbol by the lowest bit in which it differs from its
left neighbour, three times, which leaves eight labels.  Phrases begin at local maxima of the
labels; a phrase's name is a hash of its symbols, and the names are the symbols of the next
level.  A phrase border depends on a few neighbours only, so equal substrings get equal names
inside, wherever they stand.  A fingerprint holds the smallest names of the higher levels
(phrases of about 20 characters and more) and of the two lowest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that a fingerprint keeps of the levels from 3 up, and of levels 1 and 2.
UPPER, LOWER = 48, 16
#: Code points that are parsed at a time, at least one text.
CHUNK = 1 << 17
#: Partitions of the order by doc_id, at most, and cuts that are looked at one by one.
MOST_PARTS, STRIDE = 16_384, 128

U = np.uint64
_rng = np.random.default_rng(20)
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * _MIX1
    x = (x ^ (x >> U(33))) * _MIX2
    return x ^ (x >> U(33))


def _toss_table(bits: int) -> np.ndarray:
    a, b = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    x = a ^ b
    pos = np.bitwise_count((x & -x) - 1).astype(np.int64)
    return np.where(x == 0, 0, 2 * pos + ((b >> pos) & 1)).astype(np.uint8).ravel()


_TOSS7, _TOSS4 = _toss_table(7), _toss_table(4)


def _borders(sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases begin; each text of ``starts`` begins one."""
    prev = np.empty_like(sym)
    prev[1:] = sym[:-1]
    prev[starts] = ~sym[starts]
    x = sym ^ prev
    pos = np.bitwise_count((x & (~x + U(1))) - U(1))
    label = ((sym >> pos.astype(np.uint64)) & U(1)).astype(np.uint8) + 2 * np.minimum(pos, 63)
    for bits, table in ((7, _TOSS7), (4, _TOSS4)):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[starts] = label[starts] ^ 1
        label = table[(left.astype(np.uint16) << bits) | label]
    left, right = np.full_like(label, 255), np.full_like(label, 255)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[starts] = 255
    right[starts[1:] - 1] = 255
    top = (label > left) & (label > right)
    top[starts] = True
    return np.flatnonzero(top)


def phrases(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1 up: the texts' numbers and the names of their phrases."""
    counts = np.array([len(t) for t in texts], np.int64)
    sym = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U(1))
    live, levels = np.flatnonzero(counts), []
    counts = counts[live]
    while len(live):
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        # a run of a symbol is one symbol
        new = np.ones(len(sym), bool)
        new[1:] = sym[1:] != sym[:-1]
        new[starts] = True
        if not new.all():
            at = np.flatnonzero(new)
            run = np.diff(np.append(at, len(sym))).astype(np.uint64)
            sym = np.where(run > 1, _mix(sym[at] + run * _MIX2), sym[at])
            counts = np.add.reduceat(new, starts, dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        at = _borders(sym, starts)
        size = np.diff(np.append(at, len(sym)))
        where = np.minimum(np.arange(len(sym)) - np.repeat(at, size), 63)
        sym = _mix(np.add.reduceat(sym * _COEF[where], at) + size.astype(np.uint64))
        counts = np.diff(np.append(np.searchsorted(at, starts), len(at)))
        levels.append((np.repeat(live, counts), sym))
        more = counts > 1
        if not more.all():
            sym, live, counts = sym[np.repeat(more, counts)], live[more], counts[more]
    return levels


def _least(parts: list[tuple[np.ndarray, np.ndarray]], n: int, k: int) -> list[str]:
    if not parts:
        return [""] * n
    key = np.sort(np.concatenate([(d.astype(np.uint64) << U(32)) | (s >> U(32)) for d, s in parts]))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    ends = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U(32))
    raw = (key & U(0xFFFFFFFF)).astype(">u4").tobytes()
    return [raw[4 * a : 4 * min(b, a + k)].hex() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def fingerprints(texts: list[str]) -> list[str]:
    """``upper.lower``: names in hex, ascending; "" for an empty text."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        levels = phrases(texts[i:j])
        upper, lower = _least(levels[2:], j - i, UPPER), _least(levels[:2], j - i, LOWER)
        out += [f"{a}.{b}" if b else "" for a, b in zip(upper, lower, strict=True)]
        i = j
    return out


def _share(a: str, b: str, k: int) -> float:
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    if not x or not y:
        return float(not x and not y)
    least = sorted(x | y)[: k if len(x) >= k or len(y) >= k else len(x | y)]
    return sum(h in x and h in y for h in least) / len(least)


def likeness(a: str, b: str) -> float:
    """0 to 1: estimated share of phrases that two texts have in common; 1 for two empty ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (ua, la), (ub, lb) = a.split("."), b.split(".")
    low = _share(la, lb, LOWER)
    return 0.75 * _share(ua, ub, UPPER) + 0.25 * low if ua or ub else low


def edited(text: str, following: str) -> str:
    """The last third (floor) replaced by the first as many code points of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order, the row that follows its last one at the end."""
    held = None
    for batch in batches:
        rows = list(zip(batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()], strict=True))
        size = 0
        chunk = [held] if held else []
        for row in rows:
            if chunk and chunk[-1][0] == 1:
                break  # only the first row of the tail counts
            chunk.append(row)
            size += len(row[2])
            if size > CHUNK:
                yield _answer(chunk)
                chunk, size = [chunk[-1]], 0
        if len(chunk) > 1:
            yield _answer(chunk)
        held = chunk[-1] if chunk else None


def _answer(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    import hashlib

    own = [t for _, _, t in rows]
    other = [edited(t, s) for t, s in zip(own, own[1:], strict=False)]
    prints = fingerprints(own)
    prints_other = fingerprints(other)
    n = len(other)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([r[1] for r in rows[:n]], pa.int64()), "n_chars": pa.array([len(t) for t in own[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in other], pa.string()),
        "fingerprint": pa.array(prints[:n], pa.string()), "edited_fingerprint": pa.array(prints_other, pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(prints, prints_other, strict=False)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)], pa.float64()),
    })


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _cuts_up_to(cuts: list[int], x: Column, stride: int = STRIDE) -> Column:
    """How many of the ascending cuts are at most x: first by every ``stride``-th one, then within its stretch."""
    longs = lambda xs: F.lit(xs).cast("array<long>") if xs else F.array().cast("array<long>")
    before = lambda xs: F.size(F.filter(xs, lambda c: c <= x))
    if len(cuts) <= stride:
        return before(longs(cuts))
    skipped = F.greatest(before(longs(cuts[::stride])) - 1, F.lit(0)) * stride
    return skipped + before(F.slice(longs(cuts), skipped + 1, F.lit(stride)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next.

    The next document is the one of the next smaller doc_id (an integer; null comes last), after
    the last the first.  Rows of one doc_id follow each other by a hash of the text.  Null text
    is empty, with fingerprint "".  Only doc_id and text are read; an empty table gives no rows.

    Ids are cut into ranges, and one shuffle brings each range to a partition, in order; the
    first row of each range goes to the partition before it too.  The ranges' borders and first
    ids, at most ``MOST_PARTS`` of each, are all that the driver sees.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.select("doc_id")
    rows = ids.count()
    parts = max(1, min(MOST_PARTS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000), rows))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    # bucket 0 holds null ids, bucket k + 1 the ids from the k-th cut up
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + _cuts_up_to(cuts, F.col("doc_id")))
    first = {r[0]: r[1] for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id")).collect()}
    full = sorted(first)
    n = len(cuts) + 2
    above = {b: full[(i + 1) % len(full)] for i, b in enumerate(full)}
    heads = F.array(*[F.lit(first.get(b)).cast("long") for b in range(n)])
    to = F.array(*[F.lit(above.get(b, 0)) for b in range(n)])
    dealt = docs.withColumn("bucket", bucket)
    is_head = F.col("doc_id").eqNullSafe(F.element_at(heads, F.col("bucket") + 1))
    stay = F.struct(F.col("bucket").alias("part"), F.lit(0).alias("tail"))
    lead = F.struct(F.element_at(to, F.col("bucket") + 1).alias("part"), F.lit(1).alias("tail"))
    dealt = dealt.select("doc_id", "text", F.inline(F.when(is_head, F.array(stay, lead)).otherwise(F.array(stay))))
    dealt = dealt.withColumn("h", F.xxhash64("text")).repartitionById(n, F.col("part"))
    dealt = dealt.sortWithinPartitions(F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("h"))
    return dealt.select("tail", "doc_id", "text").mapInArrow(_pairs, SCHEMA)
