"""N-gram Jaccard join by prefix trees.

All documents count, for each word n-gram, in how many documents it stands (packs.ask).  That
gives one order of all n-grams, rare ones first, in which a document's set is a sorted path.
A document can link only if enough of its n-grams stand elsewhere, and two documents that link
share one of the first few n-grams of both, and differ little in size.  Documents that are joined
by such n-grams through sizes near each other, however far, form blocks; a block's sets are
stored in a trie with compressed edges, and each set walks it, sharing the overlaps of common
beginnings and leaving a subtree when the remaining lengths cannot reach the overlap that is
needed, or when the set is linked with all of the subtree already.  In a block beyond ``BLOCK``
sets all sets first walk the trie of some of them, the leaders; sets that leaders link already
need not meet again, so the rest is joined chunk by chunk, against chunks of sizes near enough
and of other leaders.  Equal sets are one set throughout.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import packs as pk
from tallyforge.llm.components import connected_components
from tallyforge.llm.stages import give_back
from tallyforge.storage import Scratch

#: Sets that a task joins at a time; a larger block is cut into chunks of about so many, and has so many leaders at most.
BLOCK, LEADERS = 512, 64
#: Bytes of all texts for each bucket of n-grams.
ASKED = 8 << 20
U = np.uint64
_COEF = np.random.default_rng(3).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; the whole sequence if it is shorter."""
    words = text.lower().split()  # of bytes: A-Z only, and at the ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        s += h[k : len(h) - size + 1 + k] * _COEF[k]
    return pk.sorted_unique(pk.mix(s))


def _need(n: int, num: int, den: int) -> int:
    """Overlap that a set of n needs with any set at all."""
    return -(-num * n // den)


class _Node:
    __slots__ = ("label", "tokens", "children", "ends", "low", "high", "rest", "one", "same")

    def __init__(self, label: list[int]):
        self.label, self.tokens = label, frozenset(label)
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.low, self.high, self.rest = 1 << 60, 0, 0
        self.one, self.same = -1, True


class PrefixTree:
    """Sets as sorted lists of numbers, and links between them."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.root = num, den, _Node([])
        self.size: list[int] = []
        self.up: list[int] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def new(self, size: int) -> int:
        self.size.append(size)
        self.up.append(len(self.up))
        return len(self.up) - 1

    def insert(self, i: int, path: list[int]) -> None:
        node, at = self.root, 0
        while True:
            node.low, node.high = min(node.low, self.size[i]), max(node.high, self.size[i])
            node.rest = max(node.rest, len(path) - at)
            if node.one < 0:
                node.one = i
            elif node.same and self.find(node.one) != self.find(i):
                node.same = False
            if at == len(path):
                node.ends.append(i)
                return
            child = node.children.get(path[at])
            if child is None:
                child = node.children[path[at]] = _Node(path[at:])
                at = len(path)
            else:
                k, most = 1, min(len(child.label), len(path) - at)
                while k < most and child.label[k] == path[at + k]:
                    k += 1
                if k < len(child.label):
                    upper = _Node(child.label[:k])
                    upper.low, upper.high, upper.one, upper.same = child.low, child.high, child.one, child.same
                    upper.rest = child.rest + len(child.label) - k
                    child.label = child.label[k:]
                    child.tokens = frozenset(child.label)
                    upper.children[child.label[0]] = child
                    node.children[path[at]] = child = upper
                at += k
            node = child

    def links(self, i: int, path: list[int]) -> None:
        """Unite set i, which isn't stored yet, with each stored set that it links with."""
        n, num, den = self.size[i], self.num, self.den
        least, most, own = _need(n, num, den), den * n // num, frozenset(path)
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.high < least or node.low > most or node.one < 0:
                continue
            if not node.same and not node.ends:
                one = self.find(node.one)
                node.same = all(c.same and self.find(c.one) == one for c in node.children.values())
            if node.same and self.find(node.one) == self.find(i):
                continue
            if node.label:
                overlap += len(own & node.tokens)
                left = len(path) - bisect_right(path, node.label[-1])
            else:
                left = len(path)
            if (num + den) * (overlap + min(left, node.rest)) < num * (n + max(node.low, least)):
                continue
            for j in node.ends:
                if (num + den) * overlap >= num * (n + self.size[j]):
                    self.up[self.find(j)] = self.find(i)
            stack.extend((c, overlap) for c in node.children.values())


def join_group(rows: list[tuple[bytes, int, bytes, bool, bytes]], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links that span the components within rows (name, size, tokens, is of the first chunk or of both, leader).

    Rows of one leader (not b"") are linked already.
    """
    tree = PrefixTree(num, den)
    led: dict[bytes, int] = {}
    rows = sorted(rows, key=lambda r: (not r[3], r[0]))
    one_sided = not all(r[3] for r in rows)
    for _, size, tokens, stored, lead in rows:
        i, path = tree.new(size), np.frombuffer(tokens, "<u8").tolist()
        if lead:
            tree.up[i] = tree.find(led.setdefault(lead, i))
        if not (stored and one_sided):
            tree.links(i, path)
        if stored:
            tree.insert(i, path)
    return [(rows[i][0], rows[r][0]) for i in range(len(rows)) if (r := tree.find(i)) != i]


def _own_sets(p: pk.Pack, n: int) -> list[np.ndarray]:
    return [shingles(t, n) for t in p.texts]


def _keys(n: int):
    def run(p: pk.Pack) -> tuple[np.ndarray, np.ndarray]:
        h = np.sort(np.concatenate([np.zeros(0, np.uint64), *_own_sets(p, n)]))
        if not len(h):
            return h, np.zeros(0, np.uint32)
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[at], np.diff(np.append(at, len(h))).astype(np.uint32)

    return run


def _frequency(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """0 for an n-gram of one document, else an eighth of a power of two of its documents."""
    order, at, total = pk.totals(keys, marks)
    code = np.where(total < 2, 0, np.minimum(255, 1 + (8 * np.log2(np.maximum(total, 1))).astype(int)))
    return pk.spread(code, order, at)


def _sets(n: int, num: int, den: int):
    """Each document's set; tokens (in the common order, those that stand elsewhere) where it may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, row in pk.read(batch):
                own, codes = _own_sets(p, n), pk.codes_of(batch, row)
                keys = pk.sorted_unique(np.concatenate([np.zeros(0, np.uint64), *own]))
                seen, cols = set(), ([], [], [], [], [])
                for h in own:
                    name = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    tokens, prefix = None, None
                    if len(h) and name not in seen:
                        seen.add(name)
                        code = codes[np.searchsorted(keys, h)].astype(np.uint64)
                        need = _need(len(h), num, den)
                        alone = int((code == 0).sum())
                        if len(h) - alone >= need:
                            path = np.sort((code << U(56)) | (h >> U(8)))[alone:].astype("<u8")
                            # the first ones of all, of which those that stand nowhere else come first
                            prefix = path[: max(0, len(h) - need + 1 - alone)].tobytes()
                            tokens = path.tobytes()
                    for c, v in zip(cols, (len(h), name, tokens, prefix), strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": p.id_column(), "n_shingles": pa.array(cols[0], pa.int64()),
                    "name": pa.array(cols[1], pa.binary()), "tokens": pa.array(cols[2], pa.binary()), "prefix": pa.array(cols[3], pa.binary()),
                })

    return run


def _size_class(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Classes of sizes: sets that link are of the same class or of two neighbouring ones."""
    tops = [1]
    while tops[-1] < 1 << 40:  # the sizes from tops[k] up to what tops[k] can link with at most
        tops.append(tops[-1] * den // num + 1)
    return np.searchsorted(np.array(tops), size, "right")


def _entries(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, "<i8") for x in batch.column("prefix").to_pylist()]
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in parts])
            band = _size_class(np.asarray(batch.column("n_shingles")), num, den).astype(np.int32)
            columns = [pa.array(np.concatenate([np.zeros(0, "<i8"), *parts])), pa.array(band[row]), batch.column("name").take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "band", "name"])

    return run


def _joined(num: int, den: int):
    """Links within each group; ``stored`` sets meet all, the others meet these only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def close() -> pa.RecordBatch:
            found = join_group(rows, num, den)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            for root, cell, *row in zip(*(batch.column(k).to_pylist() for k in ("root", "cell", "name", "n_shingles", "tokens", "stored", "lead")), strict=True):
                if (root, cell) != at and rows:
                    yield close()
                    rows = []
                at = (root, cell)
                rows.append(tuple(row))
        if rows:
            yield close()

    return run


def _links(members: DataFrame, num: int, den: int) -> DataFrame:
    """``u, v``: links of members (root, cell, name, n_shingles, tokens, stored, lead) within each root and cell."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("root", "cell", "name", "n_shingles", "tokens", "stored", "lead").repartition(parts, "root", "cell")
    return dealt.sortWithinPartitions("root", "cell").mapInArrow(_joined(num, den), "u binary, v binary")


def _large_links(members: DataFrame, keep: Scratch, num: int, den: int, block: int, leaders: int) -> DataFrame:
    """Links of blocks of more than ``block`` sets (members: root, n_sets, band, name, n_shingles, tokens).

    The leaders are copied to all chunks of their block.  After them, a chunk holds sets of one
    leader and band, or sets of one band whose leaders have less than a chunk or who have none;
    chunks of one leader don't meet, nor do chunks of bands that are not neighbours.
    """
    none = F.lit(b"")
    pick, chunks = F.xxhash64("name", F.lit(9)), F.ceil(F.col("n_sets") / F.lit(block)).cast("int")
    least = members.groupBy("root", F.pmod(pick, F.lit(leaders)).alias("k")).agg(F.min(F.struct(pick.alias("h"), "name")).alias("l"))
    least = least.select(F.col("l.name").alias("name"), F.lit(True).alias("leads"))
    marked = members.join(least.hint("merge"), "name", "left").withColumn("stored", F.coalesce("leads", F.lit(False)))
    cells = F.when(F.col("stored"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("name", F.lit(5)), chunks).cast("int")))
    first = keep.table(_links(marked.withColumn("cell", F.explode(F.transform(cells, lambda c: c.cast("long")))).withColumn("lead", none), num, den), "leader-links")
    led = connected_components(first, keep, "led").select(F.col("node").alias("name"), F.col("root").alias("lead"))
    own = members.join(led.hint("merge"), "name", "left").withColumn("lead", F.coalesce("lead", none))

    of_lead = own.groupBy("root", "band", "lead").agg(F.count("*").alias("n"))
    of_lead = of_lead.withColumn("alone", F.when(F.col("n") >= block, F.col("lead")).otherwise(none))
    of_cell = keep.table(of_lead.groupBy("root", "band", "alone").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("chunks")), "cells")
    own = own.join(of_lead.select("root", "band", "lead", "alone").hint("merge"), ["root", "band", "lead"])
    own = own.join(of_cell.hint("merge"), ["root", "band", "alone"])
    place = F.struct("band", "alone", F.pmod(F.xxhash64("name", F.lit(5)), F.col("chunks")).cast("int").alias("chunk"))
    own = own.select("root", place.alias("place"), "name", "n_shingles", "tokens", "lead")

    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    places = of_cell.select("root", "band", "alone", chunk).select("root", F.struct("band", "alone", "chunk").alias("place"))
    a, b = places.withColumnRenamed("place", "a"), places.withColumnRenamed("place", "b")
    meet = a.join(b, "root").where("a <= b and b.band - a.band <= 1 and (a.alone != b.alone or a.alone = X'')").withColumn("cell", F.xxhash64("a", "b"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("place"), F.lit(True).alias("stored")))).otherwise(
        F.array(F.struct(F.col("a").alias("place"), F.lit(True).alias("stored")), F.struct(F.col("b").alias("place"), F.lit(False).alias("stored"))))
    sides = meet.select("root", "cell", F.inline(sides))
    return first.unionByName(_links(own.join(sides.hint("merge"), ["root", "place"]), num, den))


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, leaders: int = LEADERS, pack: int = pk.PACK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``.

    A document's set are its distinct n-grams of words (ASCII lower-cased, separated by ASCII
    blanks), or its whole sequence of words if shorter.  Two documents link when den *
    intersection >= num * union; component_id is the smallest doc_id (an integer) that links
    reach.  Null or blank text has an empty set and links with nothing: its component is itself.
    Rows that repeat link as equal sets do; a null doc_id is never a component's id unless all
    its ids are null.  Only doc_id and text are read; an empty table gives no rows.
    """
    keep = Scratch(docs.sparkSession, "ngram-join")
    packs, size = pk.stored(docs, keep, pack)
    asked = pk.ask(packs, size // ASKED + 1, _keys(n), _frequency)
    sets = keep.table(asked.mapInArrow(give_back(_sets(n, num, den)), "doc_id long, n_shingles long, name binary, tokens binary, prefix binary"), "sets")
    keep.drop("packs")

    # of the sets that share a token of their prefixes, each band hangs on its least set, and neighbouring bands' least sets on each other
    some = sets.where("prefix is not null").select("name", "n_shingles", "prefix")
    entries = keep.table(some.mapInArrow(_entries(num, den), "token long, band int, name binary").distinct(), "entries")
    least = keep.table(entries.groupBy("token", "band").agg(F.min("name").alias("least")), "least")
    within = entries.join(least.hint("merge"), ["token", "band"]).select(F.col("name").alias("u"), F.col("least").alias("v"))
    up = least.select("token", (F.col("band") + 1).alias("band"), F.col("least").alias("lower"))
    between = least.join(up.hint("merge"), ["token", "band"]).select(F.col("least").alias("u"), F.col("lower").alias("v"))
    blocks = connected_components(within.unionByName(between).where("u != v"), keep, "blocks")
    sizes = blocks.groupBy("root").agg(F.count("*").alias("n_sets"))
    blocks = blocks.join(sizes.hint("merge"), "root").select(F.col("node").alias("name"), "root", "n_sets")
    blocks = blocks.join(entries.select("name", "band").distinct().hint("merge"), "name")
    members = sets.where("tokens is not null").select("name", "n_shingles", "tokens").dropDuplicates(["name"])
    members = keep.table(members.join(blocks.hint("merge"), "name"), "members")
    small = members.where(F.col("n_sets") <= block)
    links = _links(small.withColumns({"cell": F.lit(0).cast("long"), "stored": F.lit(True), "lead": F.lit(b"")}), num, den)
    large = members.where(F.col("n_sets") > block)
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, keep, num, den, block, leaders))
    links = keep.table(links, "links")
    for name in ("entries", "least", "members"):
        keep.drop(name)

    linked = connected_components(links, keep, "linked")
    names = sets.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    names = names.join(linked, F.col("name") == F.col("node"), "left").where("rows > 1 or root is not null")
    names = names.select("name", "first", F.coalesce("root", "name").alias("root"))
    ids = names.groupBy("root").agg(F.min("first").alias("component"))
    ids = names.join(ids, "root").select("name", "component")
    out = sets.select("doc_id", "n_shingles", "name").join(ids, "name", "left")
    own = (F.col("n_shingles") == 0) | F.col("component").isNull()
    return out.select("doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
