"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

A text's tokens are tagged secret-begin, secret-inside or outside from their shape, their
neighbours and features of the whole file, and decoded by Viterbi.  Tokens that cannot be part of
a secret (no digit, short, not soon after a telling word) are outside by a constraint of the
model, so a text's chain falls apart there, exactly, and only the stretches between are scored.
The field is trained by gradient ascent on its likelihood, on stretches from a bounded sample of
documents that the patterns label; each assigned secret is also shown with other words than the
separator that the patterns need.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import spans as sp

KINDS = ["assign", "access", "hex"]
# Fixed patterns, and the least length of what they must cover (group 2, all, all).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
LEAST_ASSIGN = 8
#: The same for Spark's filter on what may hold a base span.
ANY_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""

#: Words after which any token may be a secret, in either case.
TELLING = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "akia")
TOKEN = re.compile(r"[\w+/\-]+|[^\w\s+/\-]")
TRIGGER = re.compile(r"[0-9]+|(?:" + "|".join(TELLING) + r")|(?<![A-Za-z+/_-])[A-Za-z+/_-]{20,}", re.IGNORECASE | re.ASCII)
#: Tokens that a telling word opens, the length from which a token is open, characters around a trigger.
REACH, LONG, AROUND = 4, 20, 80
#: Texts of the sample with and without a base span, chains that the fit takes of one text at most, longest chain; rounds of the fit.
SAMPLE, CHAINS, LONGEST, ROUNDS = 600, 200, 400, 400
#: What stands between a telling word and its secret in the altered copies.
FILLERS = (" ", " is ", " -> ", " was set to ")
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves within the base spans."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return out + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]


def _kind(t: str) -> str:
    if not any(c.isalnum() for c in t):
        return {'"': "quote", "'": "quote", "=": "sep", ":": "sep"}.get(t, "mark")
    low = t.lower()
    if any(w in low for w in TELLING):
        return "telling"
    digits = sum(c.isdigit() for c in t)
    if digits == len(t):
        return "digits"
    if digits:
        if all(c in "0123456789abcdef" for c in t):
            return "hex"
        return "mixed" if t != low and t != t.upper() else ("lower+digits" if t == low else "upper+digits")
    return "lower" if t == low else "upper" if t == t.upper() else "title" if t[1:] == low[1:] else "camel"


def stretches(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Tokens of the parts of a text around triggers."""
    lo, hi = 0, -1
    for m in TRIGGER.finditer(text):
        if m.start() - AROUND > hi:
            if hi >= 0:
                yield _tokens(text, lo, hi)
            lo = max(0, m.start() - AROUND)
        hi = m.end() + 2 * AROUND
    if hi >= 0:
        yield _tokens(text, lo, min(hi, len(text)))


def _tokens(text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    while lo > 0 and not text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and not text[hi].isspace():
        hi += 1
    return [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]


def _file_features(text: str) -> list[str]:
    n = max(1, len(text))
    marks = text.count("{") + text.count(";") + text.count("=")
    return ["file:code" if marks * 100 > n else "file:prose", "file:lines" if text.count("\n") * 40 > n else "file:flow"]


def describe(tokens: list[tuple[str, int, int]], of_file: list[str]) -> list[tuple[list[str], bool]]:
    """Features of each token, and whether it may be part of a secret."""
    kinds, out = [_kind(t) for t, _, _ in tokens], []
    since = 99
    for i, (t, a, b) in enumerate(tokens):
        k = kinds[i]
        word = any(c.isalnum() for c in t)
        may = word and k != "telling" and (any(c.isdigit() for c in t) or len(t) >= LONG or since <= REACH)
        may |= k == "telling" and len(t) >= 16 and any(c.isdigit() for c in t)
        if not word and t in "._=+/-" and i and i + 1 < len(tokens) and tokens[i - 1][2] == a and tokens[i + 1][1] == b:
            may = True
        size = "1" if b - a < 4 else "4" if b - a < 8 else "8" if b - a < 16 else "16"
        prev = kinds[i - 1] if i else "edge"
        glued = "glued" if i and tokens[i - 1][2] == a else "apart"
        out.append((["one", k, f"{k}/{size}", f"-1:{prev}", f"-2:{kinds[i - 2] if i > 1 else 'edge'}", f"+1:{kinds[i + 1] if i + 1 < len(tokens) else 'edge'}", f"{glued}/{prev}", f"since:{min(since, 5)}/{size}", *of_file], may))
        since = 0 if k == "telling" else since + (1 if word else 0)
    return out


def _runs(may: list[bool]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(may):
        j = i
        while j < len(may) and may[j]:
            j += 1
        if j > i:
            yield i, j
        i = j + 1


class Field:
    """Weights of features by tag, and of tags in sequence; outside stands before and after a chain."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.w = np.zeros((0, 3))
        self.t = np.zeros((3, 3))

    #: Inside follows begin or inside only.
    BAN = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0.0]])

    def fit(self, chains: list[tuple[list[list[str]], list[int]]]) -> "Field":
        self.names = {n: i for i, n in enumerate(sorted({f for feats, _ in chains for x in feats for f in x}))}
        chains = sorted(chains, key=lambda c: len(c[1]))
        batches = []
        for lo in range(0, len(chains), 512):
            part = chains[lo : lo + 512]
            longest, width = max(len(y) for _, y in part), max(len(x) for feats, _ in part for x in feats)
            ids, tag = np.full((len(part), longest, width), len(self.names)), np.zeros((len(part), longest), int)
            for i, (feats, y) in enumerate(part):
                tag[i, : len(y)] = y
                for j, x in enumerate(feats):
                    ids[i, j, : len(x)] = [self.names[f] for f in x]
            batches.append((ids, tag, np.array([len(y) for _, y in part])))
        w, t = np.zeros((len(self.names) + 1, 3)), np.zeros((3, 3))
        mom, total = [np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)], sum(len(b[2]) for b in batches)
        for step in range(1, ROUNDS + 1 if total else 0):
            gw, gt = -1e-5 * w, -1e-5 * t
            for ids, tag, size in batches:
                a, b = self._gradient(w, t, ids, tag, size)
                gw, gt = gw + a / total, gt + b / total
            for p, g, k in ((w, gw, 0), (t, gt, 1)):
                mom[k] = 0.9 * mom[k] + 0.1 * g
                mom[k + 2] = 0.999 * mom[k + 2] + 0.001 * g * g
                p += 0.2 * (mom[k] / (1 - 0.9**step)) / (np.sqrt(mom[k + 2] / (1 - 0.999**step)) + 1e-8)
            w[-1] = 0
        self.w, self.t = w, t
        return self

    def _gradient(self, w, t, ids, tag, size):
        n, longest, _ = ids.shape
        e, trans = w[ids].sum(axis=2), t + self.BAN
        live = np.arange(longest)[None, :] < size[:, None]
        add = np.logaddexp.reduce
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0] + trans[0]
        for k in range(1, longest):
            nxt = add(alpha[:, k - 1, :, None] + trans[None], axis=1) + e[:, k]
            alpha[:, k] = np.where(live[:, k, None], nxt, alpha[:, k - 1])
        last = t[:, 0]
        beta[:] = last
        for k in range(longest - 2, -1, -1):
            nxt = add(trans[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(live[:, k + 1, None], nxt, last)
        z = add(alpha[:, -1] + last, axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        # a chain's alpha is carried on behind its end, where live is false
        gold = np.eye(3)[tag] * live[:, :, None]
        gw, gt = np.zeros_like(w), np.zeros_like(t)
        np.add.at(gw, ids, np.broadcast_to((gold - p)[:, :, None, :], (*ids.shape, 3)))
        for k in range(1, longest):
            both = alpha[:, k - 1, :, None] + trans[None] + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None]
            g = gold[:, k - 1, :, None] * gold[:, k, None, :] - np.exp(np.minimum(both, 0))
            gt += (g * live[:, k, None, None]).sum(axis=0)
        ends = np.arange(n), size - 1
        gt[0] += (gold[:, 0] - p[:, 0]).sum(axis=0)
        gt[:, 0] += (gold[ends] - p[ends]).sum(axis=0)
        return gw, gt

    def tags(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        e = np.array([self.w[[self.names[f] for f in x if f in self.names]].sum(axis=0) for x in feats])
        trans = self.t + self.BAN
        score, back = e[0] + trans[0], []
        for k in range(1, len(e)):
            all_ = score[:, None] + trans
            back.append(all_.argmax(axis=0))
            score = all_.max(axis=0) + e[k]
        at = int((score + self.t[:, 0]).argmax())
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return out[::-1]


def _chains(text: str, values: list[tuple[int, int]], of_file: list[str]) -> Iterator[tuple[list[list[str]], list[int]]]:
    for tokens in stretches(text):
        described = describe(tokens, of_file)
        for i, j in _runs([m for _, m in described]):
            tag, inside = [], None
            for _, a, b in tokens[i:j]:
                hit = next((v for v in values if v[0] <= a and b <= v[1]), None)
                tag.append(OUT if hit is None else INSIDE if hit == inside else BEGIN)
                inside = hit
            yield [x for x, _ in described[i:j]], tag


def chains_of(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Training chains of a text: as it stands, and each assigned secret with other words between."""
    of_file = _file_features(text)
    out = list(_chains(text, _values(text), of_file))
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_ASSIGN:
            before, after = text[max(0, m.start() - AROUND) : m.end(1)], text[m.end() : m.end() + AROUND]
            for filler in FILLERS:
                at = len(before) + len(filler)
                out += _chains(before + filler + m[2] + after, [(at, at + len(m[2]))], of_file)
    return out


def added_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the field finds that touches no base span."""
    if not len(field.w):
        return []
    out, of_file = [], None
    for tokens in stretches(text):
        of_file = of_file or _file_features(text)
        described = describe(tokens, of_file)
        for i, j in _runs([m for _, m in described]):
            start = None
            tags = [*field.tags([x for x, _ in described[i:j]]), OUT]
            for k, tag in enumerate(tags):
                if start is not None and tag != INSIDE:
                    out.append(("crf", tokens[start][1], tokens[i + k - 1][2]))
                    start = None
                if tag == BEGIN:
                    start = i + k
    return [s for s in out if not any(a < s[2] and s[1] < b for _, a, b in base)]


def train(docs: DataFrame, sample: int = SAMPLE, chains: int = CHAINS, longest: int = LONGEST) -> Field:
    """Fit on at most ``sample`` texts with a base span and as many without, chosen by a hash of the text.

    Of each text the first ``chains`` chains of at most ``longest`` tokens count, so the sample is
    bounded by rows and by their size; a text that stands in many rows counts once, and doc_id
    is not read.  Without a base span in the sample the field is empty and adds nothing.
    """
    docs = docs.where("text is not null").select("text", F.xxhash64("text", F.lit(3)).alias("h"))
    chosen = docs.groupBy(F.col("text").rlike(ANY_BASE).alias("b"), F.pmod("h", F.lit(sample)).alias("cell")).agg(F.min("h").alias("h"))
    # at most 2 * sample hashes
    rows = docs.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
                got = [c for c in chains_of(text.as_py()) if len(c[1]) <= longest][:chains]
                yield pa.RecordBatch.from_pydict({"h": pa.array([h], pa.int64()), "chains": pa.array([pickle.dumps(got)], pa.binary())})

    once = rows.mapInArrow(run, "h long, chains binary").groupBy("h").agg(F.min("chains").alias("chains"))
    found = sorted((c for r in once.collect() for c in pickle.loads(bytes(r.chains))), key=str)
    if not any(BEGIN in y for _, y in found):
        return Field()
    return Field().fit(found)


def find_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs``: base spans and, marked ``base = false``, added ones.

    Starts and ends count code points, ends exclusive.  Null or empty text has no spans; a field
    without weights adds none; rows that repeat stay; other columns are not read.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                rows = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
                out.append(rows + [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in added_spans(text, field, base)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, spans {sp.TYPE}")
