"""Packing by cost: documents fill sequences of equal length so that attention costs are alike.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n: what every token costs in the dense
layers, and what each costs against the piece's other tokens, as attention stays within a
document.  Pieces go, longest first, to the sequence that has cost least so far and still has
room for them.  Where none has, the cheapest with any room is filled and the rest goes on as a
piece of its own, so sequences are full.  What is left over at the end of a pool makes
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import LONGEST, PORTION, Codec
from tallyforge.llm.stages import give_back

LENGTH = 2048
#: Cost of a token by itself and of a pair of tokens, as in a layer 1,024 wide (24 d^2 against 4 d).
LINEAR, QUADRATIC = 6 * 1024, 1
#: Tokens that a task gathers before it packs them, rows encoded and pieces sent at a time, words of a table.
POOL, SLICE, SENT, PIECES = 2 << 20, 500, 4000, 500_000
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost long"


def cost(n: int) -> int:
    return LINEAR * n + QUADRATIC * n * n


class Open:
    """Sequences by room left; a segment tree over the amounts of room has the least cost below each node."""

    def __init__(self, most: int):
        self.leaves = 1 << int(most).bit_length()
        self.tree: list[tuple[int, int] | None] = [None] * (2 * self.leaves)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mend(self, room: int) -> None:
        at, heap, tree = room + self.leaves, self.heaps[room], self.tree
        tree[at] = heap[0] if heap else None
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = b if a is None else a if b is None or a < b else b
            at >>= 1

    def put(self, room: int, cost: int, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._mend(room)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """Cost, number and room of the cheapest sequence that has room for ``least``, which leaves the tree."""
        at, best, found, tree = least + self.leaves, None, 0, self.tree
        if tree[at] is not None:
            best, found = tree[at], at
        while at > 1:  # all right-hand siblings on the way up cover the larger rooms
            if not at & 1 and (other := tree[at + 1]) is not None and (best is None or other < best):
                best, found = other, at + 1
            at >>= 1
        if best is None:
            return None
        while found < self.leaves:
            found = 2 * found if tree[2 * found] == best else 2 * found + 1
        room = found - self.leaves
        heapq.heappop(self.heaps[room])
        self._mend(room)
        return *best, room


def capacities(total: int, length: int) -> list[int]:
    """Full sequences, and powers of two for the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balanced(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (number of the document, offset in it, size) that hold every token of every document once; no room is left."""
    pieces = []
    for i, n in enumerate(sizes):
        pieces += [(-min(length, n - at), i, at) for at in range(0, n, length)]
    heapq.heapify(pieces)
    rooms = capacities(sum(sizes), length)
    rows: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    tree = Open(length)
    for k, room in enumerate(rooms):
        tree.put(room, 0, k)
    while pieces:
        size, i, at = heapq.heappop(pieces)
        size = -size
        spent, row, room = tree.take(size) or tree.take(1)
        taken = min(size, room)
        rows[row].append((i, at, taken))
        if room > taken:
            tree.put(room - taken, spent + cost(taken), row)
        if taken < size:
            heapq.heappush(pieces, (taken - size, i, at + taken))
    return rows


class JsonCodec(Codec):
    """Ids by a byte-level file of the ``tokenizers`` library; special tokens in a text are ordinary text.

    Words of a text that are not in the table are encoded together, as one text, and told apart
    by the bytes that their tokens stand for.  When the table is full, the last full one serves
    as a second, from which words come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # a character stands for a byte
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word behind a space."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join([" " + w for w in words])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in words]), side="left") + 1
        raw, at, out = ids.tobytes(), 0, {}
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            out[w] = raw[at:end]
            at = end
        return out

    def _spaced(self, text: str) -> bytes:
        first, *words = text.split(" ")
        out = [self._ids(first)]
        for at in range(0, len(words), PORTION):
            rest = words[at : at + PORTION]
            ids = list(map(self.known.get, rest))
            if None in ids:
                if len(self.known) > PIECES:
                    self.known, self.old = {}, self.known
                new = set(rest).difference(self.known)
                self.known.update((w, self.old[w]) for w in new if w in self.old)
                if unknown := sorted(new.difference(self.old)):
                    self.known.update(self._learn(unknown))
                ids = list(map(self.known.__getitem__, rest))
                for w in unknown:
                    if len(w) > LONGEST:
                        del self.known[w]
            out += ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()


_codecs: dict[str, JsonCodec] = {}


def _codec(path: str) -> JsonCodec:
    if path not in _codecs:
        _codecs[path] = JsonCodec(path)
    return _codecs[path]


def pack_balanced(docs: DataFrame, tokenizer: str, end: int = 1, length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """Pieces of the rows of ``docs`` (doc_id, text) in sequences of at most ``length`` tokens.

    Returns doc_id, start (the document's ids before the piece), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length and sequence_cost.  A
    document's ids are those of the byte-level tokenizer file at ``tokenizer``, which must be
    on every executor, and the id ``end``; a null text is empty, so every row has a piece.  Each
    sequence is full or as long as a power of two.  Rows that repeat are packed as often, a
    null doc_id stays null, an empty table gives no rows, and other columns are not read.

    Nothing is shuffled: a task packs what it reads, ``pool`` tokens at a time, besides the
    stretches of ``length`` tokens of long documents, which fill sequences by themselves and
    go out at once.  So memory is bounded by a pool and one text, and reruns agree as long
    as the partitions of ``docs`` do: a table that is read, not the end of a shuffle.
    """
    key = docs.schema["doc_id"].dataType
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, made = _codec(tokenizer), TaskContext.get().partitionId() << 33
        tail = np.array([end], "<u4").tobytes()
        docs: list = []  # doc_id, bytes of the rest, its start, tokens of the document
        rows: list[tuple] = []
        held, kind = 0, None

        def send() -> pa.RecordBatch:
            nonlocal rows
            cols = list(zip(*rows, strict=True))
            rows = []
            types = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal docs, held, made
            for segments in balanced([len(x[1]) // 4 for x in docs], length):
                at, total, spent = 0, sum(n for _, _, n in segments), sum(cost(n) for _, _, n in segments)
                for i, start, n in segments:
                    doc, ids, before, of = docs[i]
                    rows.append((doc, before + start, n, ids[4 * start : 4 * (start + n)], of, made, at, total, spent))
                    at += n
                made += 1
                if len(rows) >= SENT:
                    yield send()
            docs, held = [], 0

        for batch in batches:
            kind = batch.column("doc_id").type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = codec.encode(text or "") + tail
                    n = len(ids) // 4
                    for start in range(0, n - length + 1, length):
                        rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, made, 0, length, cost(length)))
                        made += 1
                        if len(rows) * length >= SENT * 64:
                            yield send()
                    if n % length:
                        docs.append((doc, ids[4 * (n - n % length) :], n - n % length, n))
                        held += n % length
                if held >= pool:
                    yield from close()
            if rows:
                yield send()
        yield from close()
        if rows:
            yield send()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(give_back(run), f"doc_id {key.simpleString()}, {SCHEMA}")
