"""Deep-shallow sorting of suffixes.

Suffixes are places in one buffer.  A bucket sort by the first four bytes comes first, and some
buckets at a time go on, which bounds what is held.  Multikey quicksort partitions them in three ways by a pivot,
eight bytes at a step, all groups of a round at once; groups that are still together at the
shallow depth go to blind tries, which keep a place to branch at and the branching bytes only
and look at one suffix's whole text for each insertion.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a step of the quicksort, and steps before blind tries take over.
STEP, SHALLOW = 8, 2
#: Suffixes that are sorted at a time, unless more begin with the same four bytes.
AT_ONCE = 100_000


def quicksort(buf: np.ndarray, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int = SHALLOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``places`` within the groups from ``lo`` to ``hi``, and the groups that are equal by ``steps`` words then.

    The words lie within ``buf``.  In a round each open group takes the middle
    of three of its words as pivot; what is smaller, equal or greater becomes a group, and equal
    ones go on at the next word.
    """
    order = np.arange(len(places))
    view = np.lib.stride_tricks.sliding_window_view(buf, STEP)
    words = np.concatenate([view[places + STEP * d].view(">u8").ravel().astype(np.uint64) for d in range(steps)])
    more = hi - lo > 1
    lo, hi = lo[more], hi[more]
    depth = np.zeros(len(lo), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lo):
        size = hi - lo
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(group)) + (lo - first)[group]
        own = order[at]
        key = words[own + (len(places) * depth)[group]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        side = (key >= pivot).view(np.int8) + (key > pivot).view(np.int8)
        # stable partition: a suffix's rank among those of its group and side, behind the sides before
        count = np.zeros((len(lo), 3), np.int64)
        rank = np.empty(len(group), np.int64)
        for s in range(3):
            mine = side == s
            run = np.cumsum(mine)
            before = np.concatenate(([0], run))[first]
            count[:, s] = np.concatenate(([0], run))[first + size] - before
            rank[mine] = run[mine] - 1 - before[group[mine]]
        start = lo[:, None] + np.cumsum(count, axis=1) - count
        order[start[group, side] + rank] = own
        deeper = np.repeat(depth[:, None], 3, axis=1)
        deeper[:, 1] += 1
        open_ = count > 1
        finished = open_ & (deeper >= steps)
        done.append((start[finished], (start + count)[finished]))
        open_ &= ~finished
        lo, hi, depth = start[open_], (start + count)[open_], deeper[open_]
    if not done:
        return order, lo, hi
    begins, ends = (np.concatenate(x) for x in zip(*done, strict=True))
    return order, begins, ends


class BlindTrie:
    """Equally long strings in order.  A node is [place to branch at, children by byte]; a leaf (string, numbers)."""

    def __init__(self, string: bytes, number: int):
        self.root = (string, [number])

    def add(self, string: bytes, number: int) -> None:
        node, path = self.root, []
        while type(node) is list:  # blindly down, by the branching bytes alone
            path.append(node)
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other, numbers = node
        if other == string:
            numbers.append(number)
            return
        differ = int.from_bytes(other) ^ int.from_bytes(string)
        place = len(string) - (differ.bit_length() + 7) // 8
        leaf = (string, [number])
        above = None
        for above_next in path:  # where the strings part
            if above_next[0] >= place:
                if above_next[0] == place:
                    above_next[1][string[place]] = leaf
                    return
                break
            above = above_next
        below = above[1][string[above[0]]] if above else self.root
        node = [place, {other[place]: below, string[place]: leaf}]
        if above:
            above[1][string[above[0]]] = node
        else:
            self.root = node

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out += node[1]
        return out


def _tries(body: bytes, places: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray, skip: int, width: int) -> None:
    """Sort each group of ``order``, whose first ``skip`` bytes are equal, by a blind trie of the rest."""
    where = places[order].tolist()
    for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
        if hi - lo == 2:  # a trie of two leaves
            a, b = where[lo], where[lo + 1]
            if body[b + skip : b + width] < body[a + skip : a + width]:
                order[lo], order[lo + 1] = order[lo + 1], order[lo]
            continue
        members = order[lo:hi].tolist()
        trie = BlindTrie(body[where[lo] + skip : where[lo] + width], members[0])
        for p, m in zip(where[lo + 1 : hi], members[1:], strict=True):
            trie.add(body[p + skip : p + width], m)
        order[lo:hi] = trie.in_order()


def deep_shallow(body: bytes, places: np.ndarray, width: int) -> np.ndarray:
    """The order of ``places`` by the ``width`` bytes (8 or more) from each, which lie within ``body``."""
    buf = np.frombuffer(body, np.uint8)
    steps = min(SHALLOW, width // STEP)
    low, high = ((buf[places + k].astype(np.uint16) << 8) | buf[places + k + 1] for k in (2, 0))
    order = np.argsort(low, kind="stable").astype(np.int32)
    order = order[np.argsort(high[order], kind="stable")]
    low, high = low[order], high[order]
    starts = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(order) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(order))
    del low, high
    i = 0
    while i < len(starts):  # whole buckets, one at least
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + AT_ONCE, "right")))
        part = slice(starts[i], ends[j - 1])
        own = places[order[part]].astype(np.int64)
        within, lo, hi = quicksort(buf, own, starts[i:j] - starts[i], ends[i:j] - starts[i], steps)
        if steps * STEP < width:
            _tries(body, own, within, lo, hi, steps * STEP, width)
        order[part] = order[part][within]
        i = j
    return order
