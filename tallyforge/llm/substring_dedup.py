"""Removal of byte strings that an earlier document holds, by sorting suffixes deep and shallow.

Every window of ``SPAN`` bytes is charged to its minimizer, the 24-byte string of least hash in
it, so equal windows of any two documents are charged to equal minimizers.  All documents ask
which minimizers stand in two documents or more (packs.ask); only the stretches of text around
those meet.  Where they meet, the suffixes that begin windows are sorted (blindtrie): multikey
quicksort to a shallow depth, and blind tries for the groups that still share that much.  Equal
windows are then neighbours, and the smallest doc_id of each returns to the text.  Windows of a
minimizer that stands in very many places meet by a hash of their own bytes, one by one, so no
minimizer makes a meeting large.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import packs as pk
from tallyforge.llm.blindtrie import deep_shallow
from tallyforge.llm.stages import give_back
from tallyforge.storage import Scratch

SPAN, SEED = 50, 24
#: Places from which the windows of a minimizer meet one by one.
HOT = 50_000
#: Bytes of all texts for each bucket of minimizers, and for each bucket of stretches.
ASKED, MET = 16 << 20, 16 << 20
#: Bytes of a pack: its row stays below half a megabyte, which the JVM's heap takes more easily than larger ones.
PACK = 1 << 20
#: Bytes in which minimizers are looked for at a time.
SLICE = 1 << 20
U = np.uint64
#: Low bits of a hash that give way to the place within a slice.
_PLACE = U((1 << 24) - 1)
#: Multipliers and values of bytes that hashes are made of.
_BASE = U(0x9FB21C651E98DF25)
_BYTES = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)
_kept: list[np.ndarray] = []
_COEF = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def _slices(p: pk.Pack) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Begin, bytes and ends of texts of parts of a pack; windows over the edge of a part are in the next, too."""
    held, ends, begin, at = [], [], 0, 0
    for t in p.texts:
        if len(t) > SLICE:
            if held:
                yield begin, b"".join(held), np.array(ends)
            for lo in range(0, len(t), SLICE):
                part = t[lo : lo + SLICE + SPAN - 1]
                yield at + lo, part, np.array([len(part)])
            held, ends, begin = [], [], at + len(t)
        else:
            held.append(t)
            ends.append(at + len(t) - begin)
            if ends[-1] >= SLICE:
                yield begin, b"".join(held), np.array(ends)
                held, ends, begin = [], [], at + len(t)
        at += len(t)
    if held:
        yield begin, b"".join(held), np.array(ends)


def _minimizers(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts of one minimizer: first start, last start, the minimizer's key.

    The key is another hash than the one that is least, as least ones crowd at the lower end.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < SPAN:
        return none, none, np.zeros(0, np.uint64)
    w = buf.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << U(8 * k))
    h = np.zeros(len(buf) - SEED + 1, np.uint64)
    for k, by in zip(range(0, SEED, 8), _COEF, strict=False):  # the SEED bytes from each place, eight at a time
        h += w[k : k + len(h)] * by
    del w
    h = pk.mix(h)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = SPAN - SEED + 1
    step = 1
    while step * 2 <= size:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < size:
        low = np.minimum(low[: len(low) - (size - step)], low[size - step :])
    at = (low & _PLACE).astype(np.int64)
    valid = np.ones(len(buf) + 1, bool)
    for e in ends:  # no window goes over the end of a text
        valid[max(0, e - SPAN + 1) : e] = False
    valid = valid[: len(at)]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.zeros(len(at), bool)
    stop[:-1] = (at[1:] != at[:-1]) | ~valid[1:]
    stop[-1] = True
    return first, np.flatnonzero(stop & valid), pk.mix(h[at[first]] + U(0x632BE59BD9B4E019))


def _runs(p: pk.Pack) -> tuple[np.ndarray, ...]:
    """Of all runs of a pack: first and last start, the minimizer's hash and the text's number."""
    found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]]
    for begin, part, ends in _slices(p):
        first, last, key = _minimizers(np.frombuffer(part, np.uint8), ends)
        for held, x in zip(found, (first + begin, last + begin, key), strict=True):
            held.append(x)
    first, last, key = (np.concatenate(x) for x in found)
    ends = np.cumsum([len(t) for t in p.texts])
    return first, last, key, np.searchsorted(ends, first, "right")


def _keys(p: pk.Pack) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers, with the number of their places (up to 2 ** 30); the highest bit tells that two documents have it."""
    _, _, key, text = _runs(p)
    doc = _ranks(p.nulls, p.ids)[text]
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    if not len(key):
        return key, np.zeros(0, np.uint32)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    places = np.diff(np.append(at, len(key)))
    return key[at], (np.minimum(places, 1 << 30) | np.where(several, 1 << 31, 0)).astype(np.uint32)


def _shared(hot: int):
    """0 for a minimizer of one document, 2 for one of more than ``hot`` places, else 1."""

    def run(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        order, at, places = pk.totals(keys, marks & 0x7FFFFFFF)
        two = np.maximum.reduceat(marks[order] >> 31, at) > 0 if len(at) else np.zeros(0, bool)
        packs = np.diff(np.append(at, len(keys)))
        return pk.spread(np.where((packs > 1) | two, np.where(places > hot, 2, 1), 0), order, at)

    return run


def _ranks(nulls: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ranks of ids, equal for equal ones, null ids last."""
    order = np.lexsort((ids, nulls))
    n, i = nulls[order], ids[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], (n[1:] != n[:-1]) | (i[1:] != i[:-1])))) if len(ids) else 0
    return out


class _Stretches:
    """A pack's stretches of text around shared minimizers, in the order of their buckets, and the distinct strings among them.

    ``number`` tells which of its bucket's strings a stretch is; ``buckets`` has, for each bucket, where its stretches, its
    strings and its strings' bytes begin and end.  ``least`` is the text of smallest doc_id of each string.
    """

    def __init__(self, p: pk.Pack, codes: np.ndarray, n: int):
        self.body = body = b"".join(p.texts)
        first, last, key, text = _runs(p)
        order = np.argsort(key)
        code = np.empty(len(key), np.uint8)
        code[order] = codes[np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))] if len(key) else 0
        hot = code == 2
        size = (last - first + 1)[hot]
        each = np.repeat(first[hot], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.fromiter((xxhash.xxh3_64_intdigest(body[a : a + SPAN]) for a in each.tolist()), np.uint64, len(each))
        first, last, key, text = (np.concatenate((x[code == 1], y)) for x, y in ((first, each), (last, each), (key, own), (text, np.repeat(text[hot], size))))
        bucket = pk.bucket_of(key, n)
        buf, length = np.frombuffer(body, np.uint8), last - first + SPAN
        digest = _digests(buf, first, length)
        order = np.lexsort((digest, bucket))
        self.first, self.last, self.text, bucket, digest, length = (x[order] for x in (first, last, text, bucket, digest, length))
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (digest[1:] != digest[:-1])
        of = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
        new |= _differ(buf, self.first, length, of)  # one digest, another string: a string of its own
        index = np.cumsum(new) - 1
        string = np.where(new, index, index[of])
        rank = _ranks(p.nulls, p.ids)[self.text]
        by = np.lexsort((rank, string))
        where = np.flatnonzero(new)
        self.least = self.text[by][np.searchsorted(string[by], np.arange(len(where)))]
        self.sizes = length[where]
        at = np.repeat(self.first[where], self.sizes) + np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.bytes = buf[at].tobytes()
        used, runs = pk.cuts_of(bucket)
        strings = np.searchsorted(where, runs)
        ends = np.concatenate(([0], np.cumsum(self.sizes)))[strings]
        self.number = string - np.repeat(strings[:-1], np.diff(runs))
        cut = lambda x: [slice(*c) for c in itertools.pairwise(x.tolist())]
        self.buckets = dict(zip(used.tolist(), zip(cut(runs), cut(strings), cut(ends), strict=True), strict=True))


def _powers(n: int) -> np.ndarray:
    """``_BASE`` to the powers from 1 up; a worker keeps those that a usual pack needs."""
    if n > 4 * PACK:
        return np.cumprod(np.full(n, _BASE))
    if not _kept:
        _kept.append(np.cumprod(np.full(4 * PACK, _BASE)))
    return _kept[0][:n]


def _digests(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string, from sums over the buffer that all strings share."""
    power = _powers(len(buf) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * power[:-1])))
    # all strings as if they began where the last one does
    return pk.mix((total[first + length] - total[first]) * power[len(buf) - first] + length.astype(np.uint64))


def _differ(buf: np.ndarray, first: np.ndarray, length: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each string is another than the one at ``of``, byte for byte."""
    out = length != length[of]
    width = 2 * SPAN
    padded = np.concatenate((buf, np.zeros(width, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    check = np.flatnonzero(~out & (of != np.arange(len(of))))
    for lo in range(0, len(check), 1 << 14):
        c = check[lo : lo + (1 << 14)]
        out[c] = ((view[first[c]] != view[first[of[c]]]) & (np.arange(width) < length[c][:, None])).any(axis=1)
    return out


def _ids(nulls: np.ndarray, ids: np.ndarray) -> bytes:
    return pk.squeeze(ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes())


def _from_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = pk.unsqueeze(data)
    n = len(data) // 9
    return np.frombuffer(data, np.uint8, offset=8 * n).astype(bool), np.frombuffer(data, "<i8", n)


def _send(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, row in pk.read(batch):
                s = _Stretches(p, pk.codes_of(batch, row), n)
                sizes, cuts = s.sizes.astype(np.uint8), list(s.buckets.values())
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(list(s.buckets), pa.int32()), "pack": pa.array([p.pack] * len(cuts), pa.int64()),
                    "sizes": pa.array([pk.squeeze(sizes[c].tobytes()) for _, c, _ in cuts], pa.binary()), "body": pa.array([pk.squeeze(s.bytes[c]) for *_, c in cuts], pa.binary()),
                    "least": pa.array([_ids(p.nulls[s.least[c]], p.ids[s.least[c]]) for _, c, _ in cuts], pa.binary()),
                })

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The smallest doc_id of each window of the strings that were sent, in the order sent."""
    sizes = [np.frombuffer(pk.unsqueeze(x), np.uint8).astype(np.int64) for x in table.column("sizes").to_pylist()]
    size = np.concatenate(sizes)
    body = b"".join(pk.unsqueeze(x) for x in table.column("body").to_pylist())
    nulls, ids = (np.concatenate(x) for x in zip(*map(_from_ids, table.column("least").to_pylist()), strict=True))
    rank = _ranks(nulls, ids)
    of_rank = np.zeros(len(rank), np.int64)
    of_rank[rank] = np.arange(len(rank))
    # packs send what copies share alike: such a string is sorted once, for the least of its documents
    sent_at = np.cumsum(size) - size
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(body[a : a + n], len(known)) for a, n in zip(sent_at.tolist(), size.tolist(), strict=True)], np.int64)
    sent_windows = size - SPAN + 1
    best = np.full(len(known), len(rank))
    np.minimum.at(best, number, rank)
    rank, body = best, b"".join(known)
    size = np.fromiter(map(len, known), np.int64, len(known))
    del known
    windows = size - SPAN + 1
    # 32 bits, as a bucket's strings are some megabytes
    owner = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    place = np.arange(len(owner), dtype=np.int32) + ((np.cumsum(size) - size) - (np.cumsum(windows) - windows)).astype(np.int32)[owner]
    order = deep_shallow(body, place, SPAN)
    own = place[order]
    buf = np.frombuffer(body, np.uint8)
    differs = np.ones(len(own), bool)
    for lo in range(0, len(own) - 1, 1 << 17):
        part = np.lib.stride_tricks.sliding_window_view(buf, SPAN)[own[lo : lo + (1 << 17) + 1]]
        differs[lo + 1 : lo + len(part)] = (part[1:] != part[:-1]).any(axis=1)
    starts = np.flatnonzero(differs)
    del own, place
    low = np.empty(len(order), np.int32)
    low[order] = np.repeat(np.minimum.reduceat(rank[owner[order]], starts), np.diff(np.append(starts, len(order))))
    text = of_rank[low].astype(np.int32)
    begin, out, i = np.cumsum(windows) - windows, [], 0
    for s in sizes:
        mine, k = number[i : i + len(s)], sent_windows[i : i + len(s)]
        at = text[np.repeat(begin[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        out.append(_ids(nulls[at], ids[at]))
        i += len(s)
    return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "answer": pa.array(out, pa.binary())})


def _cut(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, row in pk.read(batch):
                s = _Stretches(p, pk.codes_of(batch, row), n)
                body = np.frombuffer(s.body, np.uint8)
                starts = [np.zeros(0, np.int64)]
                for bucket, answer in zip(batch.column("buckets")[row].as_py() or [], batch.column("answers")[row].as_py() or [], strict=True):
                    low_null, low = _from_ids(answer)
                    mine, strings, _ = s.buckets[bucket]
                    size, number = s.sizes[strings] - SPAN + 1, s.number[mine]
                    k = size[number]
                    step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    at = np.repeat((np.cumsum(size) - size)[number], k) + step
                    text = np.repeat(s.text[mine], k)
                    own_null, own = p.nulls[text], p.ids[text]
                    earlier = np.where(low_null[at] == own_null, ~own_null & (low[at] < own), own_null)
                    starts.append((np.repeat(s.first[mine], k) + step)[earlier])
                start = np.concatenate(starts)
                edge = np.bincount(start, minlength=len(body) + 1) - np.bincount(start + SPAN, minlength=len(body) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                cols = ([], [], [], [])
                ends = np.cumsum([len(t) for t in p.texts])
                for t, e in zip(p.texts, ends.tolist(), strict=True):
                    g = gone[e - len(t) : e]
                    removed = int(g.sum())
                    kept = body[e - len(t) : e][~g].tobytes() if removed else t
                    for c, v in zip(cols, (len(t), removed, int((g[1:] & ~g[:-1]).sum() + (g[:1]).sum()) if removed else 0, kept), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": p.id_column(), "n_bytes": pa.array(cols[0], pa.int64()),
                    "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.binary()),
                })

    return run


def remove_repeats(docs: DataFrame, pack: int = PACK, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) of each row of ``docs``.

    A byte goes if a string of ``SPAN`` bytes covers it that also begins in a document of smaller
    doc_id (an integer; null is larger than all).  Texts are UTF-8; null is empty; texts below SPAN
    bytes stay whole.  Rows that share a doc_id, or have none, remove nothing from each other.  Only
    doc_id and text are read; an empty table gives no rows.
    """
    keep = Scratch(docs.sparkSession, "substring-dedup")
    packs, size = pk.stored(docs, keep, pack)
    asked = keep.table(pk.ask(packs, size // ASKED + 1, _keys, _shared(hot)), "asked")
    keep.drop("packs")
    n = size // MET + 1
    sent = asked.mapInArrow(give_back(_send(n)), "bucket int, pack long, sizes binary, body binary, least binary")
    got = sent.groupBy("bucket").applyInArrow(_meet, "pack long, bucket int, answer binary")
    got = got.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("got"))
    both = asked.join(got.hint("merge"), "pack", "left").withColumn("buckets", F.col("got.bucket")).withColumn("answers", F.col("got.answer"))
    return both.mapInArrow(give_back(_cut(n)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
