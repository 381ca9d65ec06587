"""Language ID by error-correcting output codes.

Each language has a codeword.  For each bit a logistic regression on hashed 1- to 3-grams of
letters predicts which half of the languages a text belongs to; decoding sums the logistic
losses of the bits against each codeword and takes the nearest, and flags close calls.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.stages import give_back

#: Buckets of n-gram features; rounds and step of the fit.
DIM, ROUNDS, STEP = 8192, 120, 4.0
#: Documents of each language that the fit sees at most, and over all languages.
PER_LANGUAGE, IN_ALL = 256, 8192
#: A text is far from all languages above so many times the greatest ``strange`` of labelled texts that the fit has not seen.
SLACK = 4.0
_tables: dict[str, np.ndarray] = {}


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to 5 languages, else seeded random columns."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(cols, float).T
    rng, width = np.random.default_rng(5), 12 * int(np.ceil(np.log2(n)))
    best, gap = None, -1
    for _ in range(50):
        m = rng.choice((-1.0, 1.0), (n, width))
        d = ((width - m @ m.T) / 2 + width * np.eye(n)).min()
        if d > gap and (abs(m.sum(axis=0)) < n).all():
            best, gap = m, d
    return best


def _letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, 0 where there is no letter."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram shares by bucket; None if the text has no letter."""
    if not text:
        return None
    code = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = code > 0
    if not keep.any():
        return None
    keep[1:] |= code[:-1] > 0  # one gap after each word
    code = np.concatenate(([0], code[keep], [0])).astype(np.uint32)
    one = code * np.uint32(2654435761)
    two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(2246822519)
    three = (two[:-1] ^ (one[2:] >> np.uint32(11))) * np.uint32(3266489917)
    counts = sum(np.bincount(x >> np.uint32(19), minlength=DIM) for x in (one[code > 0], two, three))
    out = np.sqrt(counts.astype(np.float32))
    return out / np.linalg.norm(out)


class Model:
    """Languages, their codewords and a weight vector per bit."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs, self.code, self.far = langs, codewords(len(langs)), np.inf
        target = self.code[y] if len(langs) else np.zeros((0, 1))
        self.w = np.zeros((DIM, self.code.shape[1] if len(langs) else 1), np.float32)
        self.b = np.zeros(self.w.shape[1], np.float32)
        size = np.bincount(y, minlength=len(langs)) if len(y) else np.zeros(0)
        weight = (1 / (len(langs) * size[y]))[:, None].astype(np.float32) if len(y) else None
        for _ in range(ROUNDS if len(y) else 0):
            g = target / (1 + np.exp(np.clip(target * (x @ self.w + self.b) * 1.0, -30, 30))) * weight
            self.w += 10 * STEP * (x.T @ g).astype(np.float32) - np.float32(1e-4) * self.w
            self.b += STEP * g.sum(axis=0).astype(np.float32)

    def strange(self, margin: np.ndarray, best: int) -> float:
        """Mean loss of the bits on which the nearest language and a second agree, for the second where it is least.

        A text that mixes two languages has undecided bits only where they differ, so it is not strange.
        """
        agree = self.code == self.code[best]
        agree[best] = False
        size = agree.sum(axis=1)
        total = (np.logaddexp(0, -self.code[best] * margin) * agree).sum(axis=1)
        return float((total[size > 0] / size[size > 0]).min(initial=np.inf))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the bits and the loss against each codeword."""
        margin = x @ self.w + self.b
        # each bit's loss counts by how sure the bit is
        sure = np.abs(np.tanh(margin / 2)) + 1e-6
        return margin, (np.logaddexp(0, -self.code * margin) * sure).sum(axis=1) / sure.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool, bool]:
        """Language, score, whether it is a close call and whether the text is near any language."""
        x = features(text)
        if x is None or not self.langs:
            return "und", 0.0, False, x is not None
        margin, loss = self.decode(x)
        p = np.exp(-len(margin) * (loss - loss.min()))
        p /= p.sum()
        best = int(np.argmin(loss))
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        near = self.far == np.inf or self.strange(margin, best) <= self.far
        return self.langs[best], float(min(1.0, p[best])), bool(p[best] < 2 * second), near

    def learn_bound(self, x: np.ndarray, y: np.ndarray) -> None:
        """Set ``far`` by a fit on every other row and the rest; below three languages no two agree on a bit."""
        if len(self.langs) > 2 and len(y) >= 2 * len(self.langs):
            half = Model(self.langs, x[::2], y[::2])
            seen = [half.decode(row) for row in x[1::2]]
            self.far = SLACK * max(half.strange(margin, int(np.argmin(loss))) for margin, loss in seen)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, bound: bool = False) -> Model:
    """Fit on a bounded sample of rows with text and lang.

    Of each language the text of smallest hash in each of ``per_language`` classes of hashes
    (fewer when there are more than in_all / per_language languages) is the sample: a partial
    aggregate, without a window over a language's rows.  A text that a language has many times
    counts once; doc_id is not read.  ``bound``: also learn how far from all languages a text is
    none of them, at the price of half a fit.
    """
    labelled = labelled.where("lang is not null and text is not null")
    langs = [r[0] for r in labelled.select("lang").distinct().orderBy("lang").limit(in_all + 1).collect()]
    if len(langs) > in_all:
        raise ValueError(f"more than {in_all} languages")
    if not langs:
        return Model([], np.zeros((0, DIM)), np.zeros(0, int))
    m = max(1, min(per_language, in_all // len(langs)))
    labelled = labelled.select("lang", "text", F.xxhash64("text", F.lit(11)).alias("h"))
    chosen = labelled.groupBy("lang", F.pmod("h", F.lit(m)).alias("cell")).agg(F.min("h").alias("h")).select("lang", "h")
    # at most in_all hashes
    sample = labelled.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, h, f) for lang, h, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True) if (f := features(t)) is not None]
            at = [np.flatnonzero(f).astype("<u2") for _, _, f in rows]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([x for x, _, _ in rows], pa.string()), "h": pa.array([h for _, h, _ in rows], pa.int64()),
                "at": pa.array([a.tobytes() for a in at], pa.binary()), "v": pa.array([f[a].astype("<f2").tobytes() for (_, _, f), a in zip(rows, at, strict=True)], pa.binary()),
            })

    found = sample.mapInArrow(run, "lang string, h long, at binary, v binary")
    rows = found.groupBy("lang", "h").agg(F.min(F.struct("v", "at")).alias("f")).select("lang", "f.v", "f.at").collect()
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.v), bytes(r["at"])))
    x, y = np.zeros((len(rows), DIM), np.float32), np.array([langs.index(r.lang) for r in rows], int)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r.v, "<f2")
    have = sorted(set(y.tolist()))
    y = np.searchsorted(have, y)
    model = Model([langs[k] for k in have], x, y)
    if bound:
        model.learn_bound(x, y)
    return model


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """All columns of ``docs`` and language, score (0 to 1) and ambiguity of each row's whole text.

    A fourth name asks for a column that is true where text has a letter and is no
    stranger than ``model.far``; a model without languages or bound finds none far.
    Text that is null or without a letter is ``und`` with score 0.  Columns that had the added
    names are replaced.  Rows that repeat stay; an empty table stays empty.  No shuffle.
    """
    docs = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    types = (pa.string(), pa.float64(), pa.bool_(), pa.bool_())
    added = ", ".join(f"{name} {t}" for name, t in zip(names, ("string", "double", "boolean", "boolean"), strict=False))
    blob = zlib.compress(pickle.dumps(model), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(zlib.decompress(blob))
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate(types[: len(names)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return docs.mapInArrow(give_back(run), f"{schema}, {added}")
