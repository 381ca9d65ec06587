"""Hard negatives by distributed radix selection over integer scores.

Rows are dealt into groups that fit a task, once; anchors go to every group, in blocks, and a
task has the scores of a block of anchors against its group from one matrix product.  No pair
of rows is ever shuffled.  A window is an anchor with a range of scores and a number of rows
wanted (of its label: the positives; for each positive, of other labels: the negatives).  In
each pass a task counts a window's scores by their leading digit, counted from the window's
top, and sends the counts of the leading digits until they reach the number wanted, which is
all that can matter.  The digit in which the total reaches it narrows the window, until it is one
score wide.  Then rows at or above that score are gathered; of rows that tie at it a task
sends the smallest ids only, as many as are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.stages import give_back
from tallyforge.storage import Scratch

#: Bits of a digit; rows of a group at most, and at least where there are fewer groups than partitions; numbers in a block of scores.
DIGIT, MOST, LEAST, BLOCK = 9, 65_536, 512, 1 << 21
#: Scores are held within this bound, far beyond any of vectors with components below a million.
LIMIT = 1 << 61
_PREPARED = "key long, vec_id long, label long, size int, norm double, q binary"
_WINDOW = "array<struct<slot: int, lo: long, hi: long, need: int, shift: int>>"
_COUNTED = "anchor long, slot int, digit int, n long"
_GATHERED = "anchor long, slot int, vec_id long, row long, score long"


def prepare(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows that take part: a key, vec_id, label (long), components floor(scale * x) as doubles, their number and squared norm.

    ``vectors`` has vec_id, embedding and label; rows with a null label, a null vector or a
    null or non-finite component (after scaling, too) take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, i, label, x in zip(*(batch.column(c).to_pylist() for c in ("key", "vec_id", "label")), batch.column("embedding"), strict=True):
                with np.errstate(invalid="ignore", over="ignore"):
                    q = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype("<f8"))  # a null component becomes nan
                    if np.isfinite(q).all():
                        out.append((key, i, label, len(q), float(q @ q), q.astype("<f8").tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _PREPARED.split(", ")])

    kept = vectors.where("label is not null and embedding is not null")
    kept = kept.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.mapInArrow(give_back(run), _PREPARED)


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for i, x in enumerate(raw):
        q = np.frombuffer(x, "<f8")
        out[i, : len(q)] = q
    return out


def _exact(x: np.ndarray, top: int) -> np.ndarray:
    """The numbers in a type in which products of rows, none beyond ``top``, are exact."""
    if top < 1 << 24:
        return x.astype(np.float32)
    return x if top < 1 << 53 else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    if out.dtype == object:
        out = np.array([[max(-LIMIT, min(LIMIT, x)) for x in row] for row in out.tolist()], object).reshape(out.shape)
    return out.astype(np.int64)


class _Group:
    """The rows of a group in the order of vec_id (null last), against which blocks of anchors are held."""

    def __init__(self, rows: list[pa.RecordBatch], width: int, top: int, same: bool):
        t = pa.Table.from_batches(rows)
        self.key, self.labels = (t.column(c).to_numpy() for c in ("key", "label"))
        self.ids, self.matrix = t.column("vec_id").to_pylist(), _exact(_matrix(t.column("q").to_pylist(), width), top)
        self.width, self.top, self.same = width, top, same

    def windows(self, anchors: list[dict]) -> Iterator[tuple[dict, dict, np.ndarray, np.ndarray]]:
        """Each anchor with each of its windows, the scores of the group and which rows the window takes."""
        step = max(1, BLOCK // len(self.key))
        for at in range(0, len(anchors), step):
            some = anchors[at : at + step]
            scores = _scores(_exact(_matrix([x["q"] for x in some], self.width), self.top), self.matrix)
            for x, s in zip(some, scores, strict=True):
                fit = (self.labels == x["label"]) & (self.key != x["key"]) if self.same else self.labels != x["label"]
                for w in x["windows"]:
                    yield x, w, s, fit & (s >= w["lo"]) & (s <= w["hi"])


def _count(group: _Group, anchors: list[dict]) -> Iterator[tuple]:
    for x, w, s, fit in group.windows(anchors):
        histogram = np.bincount((w["hi"] - s[fit]) >> w["shift"])
        before = 0
        for digit in np.flatnonzero(histogram).tolist():
            n = int(histogram[digit])
            yield x["key"], w["slot"], digit, n
            before += n
            if before >= w["need"]:
                break


def _gather(group: _Group, anchors: list[dict]) -> Iterator[tuple]:
    for x, w, s, fit in group.windows(anchors):
        at = np.flatnonzero(fit)
        if len(at) > w["need"]:  # the ids are in order, so ties at the lowest score keep the smallest
            at = at[np.argsort(-s[at], kind="stable")[: w["need"]]]
        for i in at.tolist():
            yield x["key"], w["slot"], group.ids[i], int(group.key[i]), int(s[i])


def _meet(rows: DataFrame, anchors: DataFrame, groups: int, width: int, top: int, same: bool, each, schema: str) -> DataFrame:
    """``each`` of every group of ``rows`` against all ``anchors`` (key, label, q, windows), which stream past it."""
    empty = F.lit(None).cast(_WINDOW)
    own = rows.select("g", F.lit(0).alias("kind"), "key", "vec_id", "label", "q", empty.alias("windows"))
    other = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "key", F.lit(None).cast("long").alias("vec_id"), "label", "q", "windows")
    dealt = own.unionByName(other).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind", F.col("vec_id").isNull(), "vec_id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*((f.name, f.type) for f in arrow), strict=True)
        held: list[pa.RecordBatch] = []
        group, g = None, None
        for batch in batches:
            order = batch.column("g").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if order[lo] >> 1 != g:
                    g, group, held = order[lo] >> 1, None, []
                if not order[lo] & 1:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if group is None and held:
                    group, held = _Group(held, width, top, same), []
                for at in range(lo, hi if group else lo, 256):
                    some = batch.slice(at, min(256, hi - at)).select(["key", "label", "q", "windows"]).to_pylist()
                    cols = list(zip(*each(group, some), strict=True))
                    if cols:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))

    kinds = {"long": pa.int64(), "int": pa.int32()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    return dealt.mapInArrow(give_back(run), schema)


def _shift(lo: Column, hi: Column) -> Column:
    """Bits below the leading digit of a range of hi - lo + 1 scores."""
    return F.greatest(F.lit(0), F.length(F.bin(hi - lo)) - DIGIT).cast("int")


def select(keep: Scratch, label: str, rows: DataFrame, anchors: DataFrame, windows: DataFrame, groups: int, width: int, top: int, span: int, same: bool) -> DataFrame:
    """The first ``need`` rows of each window: anchor, slot, vec_id, row (its key), score, rank.

    ``windows`` has anchor (a key of ``anchors``), slot, lo, hi and need; ``same`` tells whether
    rows of the anchor's label (without itself) or of the others are meant.  Higher scores come first,
    ties by smaller vec_id (null last), then by key.  ``span`` bounds hi - lo, and so the number of passes.
    """

    def with_vectors(w: DataFrame) -> DataFrame:
        per = w.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "lo", "hi", "need", "shift"))).alias("windows"))
        return anchors.join(per, anchors.key == per.anchor).select("key", "label", "q", "windows")

    at = keep.table(windows.select("anchor", "slot", "lo", "hi", "need", F.col("hi").alias("first"), F.lit(0).cast("int").alias("above")), f"{label}-0")
    done, step = max(1, span.bit_length()), 0
    while done > 0:
        step += 1
        # a window of need n keeps the number still wanted below its top
        now = at.select("anchor", "slot", "lo", "hi", (F.col("need") - F.col("above")).alias("need"), _shift(F.col("lo"), F.col("hi")).alias("shift"))
        counted = _meet(rows, with_vectors(now), groups, width, top, same, _count, _COUNTED).groupBy("anchor", "slot", "digit").agg(F.sum("n").alias("n"))
        by = Window.partitionBy("anchor", "slot").orderBy("digit")
        summed = counted.select("*", F.sum("n").over(by).alias("upto")).join(now.select("anchor", "slot", F.col("need").alias("left")), ["anchor", "slot"])
        found = summed.where("upto >= left and upto - n < left").select("anchor", "slot", F.col("digit").cast("long").alias("digit"), (F.col("upto") - F.col("n")).cast("int").alias("more"))
        joined = at.join(found, ["anchor", "slot"], "left").withColumn("shift", _shift(F.col("lo"), F.col("hi")))
        # a window that holds fewer rows than it wants is left at its lowest score, and so takes all of them
        at = joined.selectExpr(
            "anchor", "slot", "if(digit is null, lo, greatest(lo, hi - shiftleft(digit + 1, shift) + 1)) as lo", "if(digit is null, lo, hi - shiftleft(digit, shift)) as hi",
            "need", "first", "if(digit is null, 0, above + more) as above",
        )
        at = keep.table(at, f"{label}-{step}")
        done -= DIGIT
    last = at.select("anchor", "slot", "lo", F.col("first").alias("hi"), "need", F.lit(0).cast("int").alias("shift"))
    gathered = _meet(rows, with_vectors(last), groups, width, top, same, _gather, _GATHERED)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = gathered.withColumn("rank", F.row_number().over(order))
    return ranked.join(windows.select("anchor", "slot", "need"), ["anchor", "slot"]).where("rank <= need").drop("need")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label, ``anchor`` is a condition on vec_id and label.  An
    anchor's positives are the first ``positives`` other rows of its label; of each come the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of the positive's.

    Rows that repeat are rows of their own, also as positives of one another; a null vec_id
    comes after all others in ties; vectors of different lengths count as filled up with zeros;
    an empty table, or one without anchors, gives no rows; other columns are not read.  Scores
    beyond 2^61 either way count as 2^61.  The prepared rows are written once, so keys hold for all passes.
    """
    spark, keep = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    rows = keep.table(prepare(vectors, scale), "rows")
    n, width, norm = rows.agg(F.count("*"), F.max("size"), F.max("norm")).first()
    top = min(LIMIT, int(norm or 0) + 1)
    groups = max(-(-n // MOST), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)), 1)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    anchors = keep.table(rows.where(anchor).select("key", "vec_id", "label", "q"), "anchors")

    want = anchors.select(F.col("key").alias("anchor"), F.lit(0).alias("slot"), F.lit(-top).cast("long").alias("lo"), F.lit(top).cast("long").alias("hi"), F.lit(positives).alias("need"))
    first = keep.table(select(keep, "positives", rows, anchors, want, groups, width or 1, top, 2 * top, True), "positives")

    p = F.col("score")
    ranges = first.select("anchor", F.col("rank").alias("slot"), _percent("score", low, up=True).alias("lo"), _percent("score", high, up=False).alias("hi"), F.lit(negatives).alias("need"))
    ranges = keep.table(ranges.where("lo <= hi"), "ranges")
    span = ranges.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    second = select(keep, "negatives", rows, anchors, ranges, groups, width or 1, top, span, False)

    pairs = first.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"))
    found = second.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "slot"])
    named = found.join(anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _percent(x: str, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a long column, rounded up or down, without a product that could overflow."""
    rest = f"{percent} * pmod({x}, 100)"
    return F.expr(f"{percent} * (({x} - pmod({x}, 100)) div 100) + ({rest}{' + 99' * up}) div 100").cast("long")
