"""Bootstrap intervals of means: exact replays of a seeded generator by one task or many, and an estimate in one pass."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.functions import twister
from tallyforge.storage import Scratch

#: Rows of a group up to which one task replays its resamples; words of a stretch beyond, and values of a piece.
ALONE, STRETCH, BLOCK = 50_000, 1 << 24, 1 << 14
#: Draws held at a time, and bytes of values that a task of a large group holds, but for its last piece.
CHUNK, HELD = 1 << 19, 1 << 25
STATS = "n long, mean double, median double, std double, low double, high double"


def ranks(rounds: int, confidence: float = 0.95) -> tuple[int, int]:
    """Places, from 0 up, of an interval's ends among the sorted means of ``rounds`` resamples."""
    tail = round((1 - confidence) / 2, 12)
    return max(0, math.floor(tail * (rounds - 1))), min(rounds - 1, math.ceil(round((1 - tail) * (rounds - 1), 9)))


def draws(n: int, total: int, seed: int) -> Iterator[np.ndarray]:
    """``total`` indexes below n, the ones that ``random.Random(seed).randrange(n)`` gives, some at a time.

    That generator is a Mersenne Twister seeded by the integer's 32-bit words; an index is the top bits of a
    word, and words that give n or more are passed over.
    """
    words = [abs(seed) >> s & 0xFFFFFFFF for s in range(0, max(1, abs(seed).bit_length()), 32)]
    raw = np.random.RandomState(words)._bit_generator
    bits = n.bit_length()
    if bits > 32:
        raise ValueError("more rows than a word can tell apart")
    left = total
    while left:
        got = (raw.random_raw(min(CHUNK, 2 * left + 64)) >> np.uint64(32 - bits)).astype(np.int64)
        got = got[got < n][:left]
        left -= len(got)
        yield got


def resampled_means(values: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Means of ``rounds`` resamples, each of as many values, drawn one after the other."""
    sums, at = np.zeros(rounds), 0
    for index in draws(len(values), rounds * len(values), seed):
        of = np.arange(at, at + len(index)) // len(values)
        sums += np.bincount(of, weights=values[index], minlength=rounds)
        at += len(index)
    return sums / len(values)


def summary(values: np.ndarray, rounds: int, confidence: float, seed: int) -> tuple:
    """n, mean, median, sample deviation and interval; zeros for none, the mean as both ends for one value or no rounds."""
    if not len(values):
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    mean, std = values.mean(), values.std(ddof=1) if len(values) > 1 else 0.0
    if len(values) == 1 or rounds <= 0:
        low = high = mean
    else:
        means = np.sort(resampled_means(values, rounds, seed))
        low, high = means[list(ranks(rounds, confidence))]
    return len(values), mean, float(np.median(values)), std, low, high


def exact_summary(df: DataFrame, group: str, order: str, value: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``group`` and n, mean, median, std, low, high of its values in the order of ``order``.

    The resamples are those of Python's own generator, so any engine that has it agrees.  A group's values
    are in one task, as the generator runs through them in turn: for groups of any size there is ``interval``.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(order, kind="stable")[value].to_numpy(float)
        return pd.DataFrame([(key[0], *summary(values, rounds, confidence, seed))])

    kind = df.schema[group].dataType.simpleString()
    return df.select(group, order, value).where(F.col(value).isNotNull()).groupBy(group).applyInPandas(run, f"{group} {kind}, {STATS}")


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _multiplicities(keys: np.ndarray, b: int, seed: int) -> np.ndarray:
    """How often resample b takes each row: Poisson of mean 1, by a hash of the row's key."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + b * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(33))) >> np.uint64(11)).astype(float) / (1 << 53), "right")


def poisson_summary(df: DataFrame, group: str, key: str, value: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``group, n, mean, low, high`` for groups of any size: each row takes part in a resample as often as a hash of its key says.

    A task folds its rows into one sum and one count for each group and resample, so what is shuffled does not
    grow with the rows, and no group is in one task.  Rows of equal key take part alike.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            rows = batch.to_pandas()
            for g, part in rows.groupby("g", dropna=False):
                s = sums.setdefault(None if pd.isna(g) else g, [0, 0.0, np.zeros(rounds), np.zeros(rounds)])
                x, k = part["x"].to_numpy(float), part["k"].to_numpy(np.int64).view(np.uint64)
                s[0] += len(x)
                s[1] += x.sum()
                for b in range(rounds):
                    m = _multiplicities(k, b, seed)
                    s[2][b] += m @ x
                    s[3][b] += m.sum()
        if sums:
            cols = [pa.array(list(sums), batch.schema.field("g").type), *(pa.array([s[i].tolist() if i > 1 else s[i] for s in sums.values()]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "n", "total", "sums", "counts"])

    kind = df.schema[group].dataType.simpleString()
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("x"))
    parts = rows.mapInArrow(fold, f"g {kind}, n long, total double, sums array<double>, counts array<double>")
    whole = parts.groupBy("g").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    each = parts.select("g", F.posexplode(F.arrays_zip("sums", "counts")).alias("b", "s")).groupBy("g", "b").agg(F.try_divide(F.sum("s.sums"), F.sum("s.counts")).alias("m"))
    low, high = ranks(rounds, confidence)
    drawn = each.groupBy("g").agg(F.collect_list("m").alias("ms")).withColumnRenamed("g", "h")
    # a resample that took no row at all has the group's mean
    means = F.array_sort(F.concat("ms", F.array_repeat("mean", rounds - F.size("ms"))))
    joined = whole.join(drawn, F.col("g").eqNullSafe(F.col("h"))).withColumn("ms", means)
    return joined.select(F.col("g").alias(group), "n", "mean", F.get("ms", F.lit(low)).alias("low"), F.get("ms", F.lit(high)).alias("high"))


def _words(state: np.ndarray, at: int, words: int, n: int) -> Iterator[np.ndarray]:
    """``words`` words from place ``at`` on, cut to the bits of n, some at a time."""
    raw, bits = twister.generator(twister.jumped(state, at) if at else state), n.bit_length()
    for done in range(0, words, CHUNK):
        yield raw.random_raw(min(CHUNK, words - done)) >> np.uint64(32 - bits)


def _indexes(state: np.ndarray, at: int, words: int, n: int) -> Iterator[np.ndarray]:
    """What of ``words`` words from place ``at`` on are indexes below n, some at a time."""
    for found in _words(state, at, words, n):
        found = found.view(np.int64)
        yield found[found < n]


def _stretches(n: int, rounds: int, length: int) -> int:
    """Stretches of words that hold ``rounds * n`` indexes, but for a chance below 1e-14."""
    hit, total = n / (1 << n.bit_length()), n * rounds
    return math.ceil((total / hit + 8 * math.sqrt(total * (1 - hit)) / hit + 64) / length)


def _pieces(df: DataFrame, group: str, order: str, value: str, block: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Values in the order of their group, packed some at a time: no row is sent or gathered after the sort.

    ``g``; ``p`` and ``at``, the part of the order and the place within it, among values of g; ``k`` values, their ``total`` and those of ``also``;
    ``packed``, a byte each by the distinct ``kinds`` where they are 256 at most (``few``), else the values.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("x"), *(F.col(c).cast("double").alias(f"a{j}") for j, c in enumerate(also)))
    ranged = rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o", "x").drop("o").withColumn("p", F.spark_partition_id())

    def same(a: object, b: object) -> bool:
        # NaN is written like NaN, in structs too
        return a == b or repr(a) == repr(b)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = (), 0
        for batch in batches:
            keys, found, begin = batch["g"], [], 0
            values, more = batch["x"].to_numpy(), [batch[f"a{j}"].to_numpy(zero_copy_only=False) for j in range(len(also))]
            while begin < batch.num_rows:
                g = keys[begin].as_py()
                if not last or not same(last[0], g):
                    last, at = (g,), 0
                # equal keys are neighbours
                end = bisect_left(range(batch.num_rows), True, begin + 1, key=lambda i, g=g: not same(keys[i].as_py(), g))
                for i in range(begin, end, block):
                    cut = slice(i, min(i + block, end))
                    kinds, codes = np.unique(values[cut], return_inverse=True)
                    few = len(kinds) <= 256
                    found.append((i, at, len(codes), values[cut].sum(), [x[cut].sum() for x in more], few, kinds if few else [], (codes.astype("u1") if few else values[cut].astype("<f8")).tobytes()))
                    at += len(codes)
                begin = end
            if found:
                first, *cols = zip(*found, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.float64()), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(first)), batch["p"].take(pa.array(first)), *cols], names=["g", "p", "at", "k", "total", "also", "few", "kinds", "packed"])

    kind = df.schema[group].dataType.simpleString()
    return ranged.mapInArrow(pack, f"g {kind}, p int, at long, k long, total double, also array<double>, few boolean, kinds array<double>, packed binary")


def _unpacked(t: pa.Table, at: np.ndarray, held: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """``held`` with the values of each piece from place ``at`` on, or their places in ``kinds``."""
    for i, few, own, x in zip(at.tolist(), t["few"].to_pylist(), t["kinds"].to_pylist(), t["packed"], strict=True):
        values = np.frombuffer(x.as_buffer(), "u1" if few else "<f8")
        if few:
            values = (np.array(own) if kinds is None else np.searchsorted(kinds, own).astype("u1"))[values]
        held[i : i + len(values)] = values
    return held


def _alone(pieces: DataFrame, rounds: int, confidence: float, seed: int) -> DataFrame:
    """``h, low, high`` of groups that one task each folds."""
    kind = pieces.schema["g"].dataType
    arrow = to_arrow_type(kind)

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("p", "ascending"), ("at", "ascending")])
        ends = np.cumsum(t["k"].to_numpy())
        low, high = summary(_unpacked(t, ends - t["k"].to_numpy(), np.empty(ends[-1])), rounds, confidence, seed)[4:]
        return pa.table({"h": t["g"][:1].cast(arrow), "low": [low], "high": [high]})

    # packed values are few bytes but many draws, so their size must not decide how many tasks fold them
    tasks = 8 * max(1, pieces.sparkSession.sparkContext.defaultParallelism)
    return pieces.repartition(tasks, "g").groupBy("g").applyInArrow(fold, f"h {kind.simpleString()}, low double, high double")


def _stretched(keep: Scratch, pieces: DataFrame, sizes: DataFrame, rounds: int, confidence: float, seed: int, length: int) -> DataFrame | None:
    """``h, low, high`` of the groups in ``sizes``, each by many tasks; None if there are none.  See ``stretched_interval``."""
    state, kind = twister.seeded(seed), pieces.schema["g"].dataType
    arrow = to_arrow_type(kind)
    need = F.udf(lambda n: _stretches(n, rounds, length), "long")
    stretches = sizes.select("g", "n", need("n").alias("all"))
    total = stretches.agg(F.sum("all")).first()[0]
    if not total:
        return None
    tasks = 4 * max(1, pieces.sparkSession.sparkContext.defaultParallelism)
    each = math.ceil(total / tasks)
    lots = stretches.select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(each).cast("long"))).alias("s"), "all")
    lots = lots.select("g", "n", "s", F.least(F.lit(each).cast("long"), F.col("all") - F.col("s")).alias("each"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                words = _words(state, row["s"] * length, row["each"] * length, row["n"])
                found.append(sum(int(np.count_nonzero(w < row["n"])) for w in words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["g", "n", "s", "each", "hits"])

    counted = lots.repartition(tasks).mapInArrow(count, f"g {kind.simpleString()}, n long, s long, each long, hits long")
    before = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    begun = keep.table(counted.withColumn("start", F.coalesce(F.sum("hits").over(before), F.lit(0))), "begun")
    lacking = begun.groupBy("g").agg(F.sum("hits").alias("hits"), F.first("n").alias("n")).where(F.col("hits") < F.col("n") * rounds)
    if not lacking.isEmpty():
        raise ValueError("the stretches hold too few draws: pass another length")

    def fold(t: pa.Table) -> pa.Table:
        n, at = t["n"][0].as_py(), t["start"][0].as_py()
        end, few, places = n * rounds, t["all_few"][0].as_py(), t["i"].to_numpy()
        lo, size = places.min(), t["k"].to_numpy().sum()
        # pieces of a group of few values share one table of them
        kinds = np.unique(t["kinds"].combine_chunks().flatten().to_numpy()) if few else None
        held = _unpacked(t, places - lo, np.empty(size, "u1" if few else float), kinds)
        sums = np.zeros(rounds)
        for got in _indexes(state, t["s"][0].as_py() * length, t["each"][0].as_py() * length, n):
            got = got[: max(0, end - at)]
            if not len(got):
                break
            cuts = np.arange(-at % n, len(got), n)
            cuts = cuts if len(cuts) and cuts[0] == 0 else np.concatenate([[0], cuts]).astype(np.int64)
            if len(held) < n:
                here = (got >= lo) & (got < lo + len(held))
                taken = held[np.where(here, got - lo, 0)]
                taken = np.where(here, kinds[taken] if few else taken, 0.0)
            else:
                taken = kinds[held[got]] if few else held[got]
            first = at // n
            sums[first : first + len(cuts)] += np.add.reduceat(taken, cuts)
            at += len(got)
        b = np.flatnonzero(sums)
        return pa.table({"g": pa.array([t["g"][0].as_py()] * len(b), arrow), "b": pa.array(b, pa.int64()), "sum": pa.array(sums[b])})

    within = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("g", "p").agg(F.sum("k").alias("k")).select(F.col("g").alias("h"), F.col("p").alias("q"), F.coalesce(F.sum("k").over(within), F.lit(0)).alias("begin"))
    placed = pieces.join(starts, F.col("g").eqNullSafe(F.col("h")) & (F.col("p") == F.col("q"))).select("g", (F.col("begin") + F.col("at")).alias("i"), "k", "few", "kinds", "packed")
    kinds = pieces.select("g", "few", F.explode_outer("kinds").alias("kind")).distinct().groupBy("g").agg((F.every("few") & (F.count_distinct("kind") <= 256)).alias("all_few"))
    # some four runs for each core, and one for each further group
    runs = begun.drop("hits").join(kinds.withColumnRenamed("g", "f"), F.col("g").eqNullSafe(F.col("f"))).drop("f").withColumnRenamed("g", "h")
    met = placed.join(F.broadcast(runs), F.col("g").eqNullSafe(F.col("h"))).drop("h")
    met = met.withColumn("part", F.floor(F.col("i") / F.when(F.col("all_few"), HELD).otherwise(max(1, HELD // 8))))
    sums = met.repartition(2 * tasks, "g", "s", "part").groupBy("g", "s", "part").applyInArrow(fold, f"g {kind.simpleString()}, b long, sum double")
    # a resample whose sum is zero has sent nothing
    zeros = sizes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))).alias("b"), F.lit(0.0).alias("sum"))
    sums = zeros.unionByName(sums).groupBy("g", "b").agg(F.sum("sum").alias("sum"))
    means = sums.groupBy("g").agg(F.array_sort(F.collect_list("sum")).alias("sums")).join(sizes.select(F.col("g").alias("h"), "n"), F.col("g").eqNullSafe(F.col("h")))
    low, high = ranks(rounds, confidence)
    return means.select("h", *((F.get("sums", F.lit(at)) / F.col("n")).alias(name) for name, at in (("low", low), ("high", high))))


def _intervals(df: DataFrame, group: str, order: str, value: str, rounds: int, confidence: float, seed: int, alone: int, length: int, block: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``group, n, mean, low, high`` and the means of ``also``.  The rows are read once."""
    keep = Scratch(df.sparkSession, "bootstrap")
    pieces = keep.table(_pieces(df, group, order, value, block, also), "pieces")
    means = [(F.sum(F.col("also")[j]) / F.sum("k")).alias(c) for j, c in enumerate(also)]
    sizes = keep.table(pieces.groupBy("g").agg(F.sum("k").alias("n"), (F.sum("total") / F.sum("k")).alias("mean"), *means), "sizes")
    # one value, or none drawn, has its mean as both ends
    large = sizes.where(F.col("n") > max(1, alone)) if rounds > 0 else sizes.limit(0)
    ends = []
    if alone > 0 and rounds > 0:
        # one key for each ``alone`` values at most
        keys = F.broadcast(large.select(F.col("g").alias("h")))
        ends.append(_alone(pieces.join(keys, F.col("g").eqNullSafe(F.col("h")), "left_anti"), rounds, confidence, seed))
        pieces = pieces.join(keys, F.col("g").eqNullSafe(F.col("h")), "left_semi")
    stretched = _stretched(keep, pieces, large, rounds, confidence, seed, length)
    ends += [] if stretched is None else [stretched]
    name = [F.col("g").alias(group), "n", "mean"]
    if not ends:
        return sizes.select(*name, F.col("mean").alias("low"), F.col("mean").alias("high"), *also)
    found = reduce(DataFrame.unionByName, ends)
    joined = sizes.join(found, F.col("g").eqNullSafe(F.col("h")), "left")
    return joined.select(*name, *(F.coalesce(c, "mean").alias(c) for c in ("low", "high")), *also)


def stretched_interval(df: DataFrame, group: str, order: str, value: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 0, length: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """``group, n, mean, low, high``, the ends as ``exact_summary`` has them, by many tasks for a group of any size.

    The generator's words are cut into stretches and these into runs of like length, some four for each core over all groups; a task jumps to
    its run and goes through it.  A first pass counts which of its words are indexes, so prefix sums tell every run with which draw of which
    resample it begins.  A second pass folds each run over the values to one sum for a resample.  Values go in pieces of ``block`` at
    most, a byte each where the group has 256 kinds of them at most; a task holds ``HELD`` bytes of them, and only a group of more has its words made
    again for the next ones.  What is shuffled are the rows, once, the pieces, once for each run, and sums.  Sums may differ in the last bits from
    those of one task.  Ties in ``order`` go by value.
    """
    return _intervals(df, group, order, value, rounds, confidence, seed, 0, length, block)


def interval(df: DataFrame, group: str, key: str, value: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 0, alone: int = ALONE) -> DataFrame:
    """``group, n, mean, low, high``: the exact replay for groups of any size.

    Groups of at most ``alone`` rows are folded in one task each, larger ones by stretches of the generator's words;
    either way the draws are the same.  For an estimate that needs one pass over the rows, see ``poisson_summary``.
    """
    return _intervals(df, group, key, value, rounds, confidence, seed, alone, STRETCH, BLOCK)


def statistics(df: DataFrame, group: str, key: str, value: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``group, n, mean, median, std, low, high`` as ``exact_summary`` has them, for groups of any size.

    The median counts distinct values, of which scores have few.
    """
    known = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    ends = interval(df, group, key, value, rounds, confidence, seed).withColumnRenamed(group, "__g")
    return known.join(ends, F.col(group).eqNullSafe(F.col("__g"))).select(group, "n", "mean", "median", "std", "low", "high")


def paired(rows: DataFrame, group: str, example: str, baseline: str, contender: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``group, common_n, baseline_mean, contender_mean, mean_difference, low, high`` of rows that have both values."""
    both = rows.where(F.col(baseline).isNotNull() & F.col(contender).isNotNull()).withColumn("__d", F.col(contender) - F.col(baseline))
    sides = both.select(group, example, "__d", F.col(baseline).alias("baseline_mean"), F.col(contender).alias("contender_mean"))
    found = _intervals(sides, group, example, "__d", rounds, confidence, seed, ALONE, STRETCH, BLOCK, ("baseline_mean", "contender_mean"))
    return found.select(group, F.col("n").alias("common_n"), "baseline_mean", "contender_mean", F.col("mean").alias("mean_difference"), "low", "high")


def paired_interval(deltas: DataFrame, group: str, order: str, value: str, rounds: int = 100, seed: int = 7) -> DataFrame:
    """``group, low, high``: the ends of the means of ``rounds`` resamples by indexes that SQL can derive.

    Resample b takes, for j below n, the value at place md5(seed|b|j) mod n.  A group's values are in one task: this is for
    parity with other engines on cohorts that fit there; ``interval`` is for all else.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(order, kind="stable")[value].to_numpy(float)
        n, means = len(values), np.empty(rounds)
        for b in range(rounds):
            start = hashlib.md5(f"{seed}|{b}|".encode())
            at = np.empty(n, np.int64)
            for j in range(n):
                h = start.copy()
                h.update(b"%d" % j)
                at[j] = int.from_bytes(h.digest()[:4]) >> 4
            means[b] = values[at % n].mean()
        low, high = np.sort(means)[list(ranks(rounds))]
        return pd.DataFrame([(key[0], low, high)])

    kind = deltas.schema[group].dataType.simpleString()
    found = deltas.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} {kind}, low double, high double")
    return found.select(group, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
