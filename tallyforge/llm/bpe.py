"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text is cut before spaces that follow something that is no white space.  No match of the
pre-splitting pattern spans such a place, and what follows is matched alike with or without
what stands before, so the pieces' tokens are the text's tokens.  Words repeat, so each
Python worker keeps a bounded table of their ids.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.stages import give_back

#: White space other than space and line feed, in either Python's or Unicode's sense.
_OTHER = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: Safe places in a text of any kind: before a space that follows a visible ASCII character.
_SAFE = re.compile(r"(?<=[!-~])(?= )")
#: Entries of the table of pieces, words after which its size is looked at, the longest piece that
#: goes there, and the characters from which a text of any kind is cut at all.
PIECES, PORTION, LONGEST, LONG = 200_000, 20_000, 32, 50_000
#: Rows that are encoded and sent on at a time.
SLICE = 500
_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Ids as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> "Codec":
        key = (ranks_path, pattern)
        if key not in _codecs:
            _codecs[key] = cls(*key)
        return _codecs[key]

    def _ids(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def _spaced(self, text: str) -> bytes:
        """A text whose white space is single spaces and line feeds, no two side by side."""
        known = self.known
        first, *words = text.split(" ")
        out = [self._ids(first)]
        for at in range(0, len(words), PORTION):
            rest = words[at : at + PORTION]
            ids = list(map(known.get, rest))
            if None in ids:
                if len(known) > PIECES:
                    known.clear()
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = known.get(rest[i]) or self._ids(" " + rest[i])
                        if len(rest[i]) <= LONGEST:
                            known[rest[i]] = ids[i]
            out += ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not ("  " in text or " \n" in text or "\n " in text or text[-1:] == " " or _OTHER.search(text)):
            return self._spaced(text)
        if len(text) < LONG:
            return self._ids(text)
        out, held, size = [], [], 0
        for piece in _SAFE.split(text):
            held.append(piece)
            size += len(piece)
            if size >= LONG:
                out.append(self._ids("".join(held)))
                held, size = [], 0
        return b"".join(out) + self._ids("".join(held))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return self.encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def encode(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """``doc_id, n_tokens, token_ids`` (binary, little-endian unsigned 32-bit) of each row of ``docs``.

    With ``decode`` also ``decoded``, the bytes that the ids stand for.  A null text is empty
    and has no tokens; rows that repeat give rows that repeat; other columns are not read.
    ``ranks_path`` must exist on every executor.  ``pattern`` must be one by which no match goes
    over a space that follows something visible, other than at the match's beginning, and a match
    doesn't depend on what stands before it, as with the patterns of the public byte-level
    vocabularies; texts are cut at such places.  Nothing is shuffled.
    """
    key = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [codec.encode(x.as_py() or "") for x in part.column("text")]
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())}
                if decode:
                    cols["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {key.simpleString()}, n_tokens long, token_ids binary" + ", decoded binary" * decode
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(give_back(run), schema)
