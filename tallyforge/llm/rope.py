"""Ropes: texts as balanced trees of pieces, cut and joined without copying what stays.

A unit is white space with the word behind it, or white space at the end of the text.  A leaf
holds some whole units; every node caches how many units and code points lie below it, so a
cut at a rank of either kind goes down one path.  Nodes don't change; trees share them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: Code points of a leaf, if a word ends there; a longer word makes a longer leaf.
LEAF = 2048


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf has a text, any other node two sides."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None
    height: int = field(default=0)


EMPTY = Rope(0, 0)


def leaf(text: str, units: int | None = None) -> Rope:
    return Rope(len(UNIT.findall(text)) if units is None else units, len(text), text)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, "", a, b, 1 + max(a.height, b.height))


def _level(a: Rope, b: Rope) -> Rope:
    """A node of two trees whose heights differ by two at most, turned so that its sides differ by one."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """Both texts in one tree; the lower one is hung in where heights meet."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _level(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _level(concat(a, b.left), b.right)
    return _node(a, b)


def build(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of ``text``; leaves end where a word does, ``size`` code points on at the earliest."""
    level, at = [], 0
    while at < len(text):
        found = _WORD_END.search(text, at + size - 1)
        end = found.end() if found else len(text)
        level.append(leaf(text[at:end]))
        at = end
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        if len(level) > 1 and level[-1].height < level[-2].height:  # an odd one out joins its neighbour
            level[-2:] = [concat(*level[-2:])]
    return level[0] if level else EMPTY


def _cut_leaf(x: Rope, units: int | None, chars: int) -> tuple[Rope, Rope]:
    if units is not None:
        for n, found in enumerate(UNIT.finditer(x.text), 1):
            if n == units:
                chars = found.end()
                break
    head = leaf(x.text[:chars], units)
    return head, leaf(x.text[chars:], None if units is None else x.units - units)


def _split(x: Rope, rank: int, by_units: bool) -> tuple[Rope, Rope]:
    total = x.units if by_units else x.chars
    if rank <= 0:
        return EMPTY, x
    if rank >= total:
        return x, EMPTY
    if x.left is None:
        return _cut_leaf(x, rank if by_units else None, rank)
    before = x.left.units if by_units else x.left.chars
    if rank <= before:
        a, b = _split(x.left, rank, by_units)
        return a, concat(b, x.right)
    a, b = _split(x.right, rank - before, by_units)
    return concat(x.left, a), b


def split_units(x: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest."""
    return _split(x, rank, True)


def split_chars(x: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest."""
    return _split(x, rank, False)


def leaves(x: Rope) -> Iterator[str]:
    stack = [x]
    while stack:
        x = stack.pop()
        if x.left is None:
            yield x.text
        else:
            stack += (x.right, x.left)


def text_of(x: Rope) -> str:
    return "".join(leaves(x))
