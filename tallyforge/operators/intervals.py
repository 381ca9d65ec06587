"""Joins of intervals: overlap and containment by buckets of time, without a comparison of all with all.

Buckets have sizes WIDTH * FAN^level.  An interval's own level is the least whose buckets are
longer than it, so it meets two buckets of its level at most, and of each coarser one.  Two
intervals meet at the coarser of their own levels: there one of them is at home, the other
is at home or shorter.  So a long interval costs a few rows, and short ones never meet in large buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import Scratch

#: Finest buckets in the intervals' unit, times by which each level's are longer, and levels at most (64 bits).
WIDTH, FAN, LEVELS = 1_000_000, 8, 22
#: Rows of a bucket, on the side with the finer intervals, beyond which it is split.
HOT = 20_000


def _width(level: Column, width: int) -> Column:
    return F.floor(F.pow(F.lit(float(FAN)), level) * width).cast("long")


def _levelled(df: DataFrame, on: list[str], start: str, end: str, side: str, width: int) -> DataFrame:
    """Valid intervals with their own level: ``on``, a struct of all columns, start, end and own level under names that end in the side."""
    length = (F.col(end) - F.col(start)).cast("double")
    own = F.greatest(F.lit(0), F.floor(F.log(F.greatest(length, F.lit(1.0)) / width) / F.log(F.lit(float(FAN)))) + 1).cast("int")
    kept = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    return kept.select(*on, F.struct(*df.columns).alias(side), F.col(start).cast("long").alias(f"s_{side}"), F.col(end).cast("long").alias(f"e_{side}"), own.alias(f"own_{side}"))


def _placed(df: DataFrame, side: str, levels: list[int], width: int, home: bool, finer: bool) -> DataFrame:
    """A row for each bucket at the interval's own level (``home``) and at coarser ones among ``levels`` (``finer``)."""
    own = F.col(f"own_{side}")
    kept = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: (k == own) & F.lit(home) | (k > own) & F.lit(finer))
    out = df.withColumn("level", F.explode(kept)).withColumn("size", _width(F.col("level"), width))
    first, last = (F.expr(f"({x}_{side} - pmod({x}_{side}, size)) div size") for x in "se")
    return out.withColumn(f"first_{side}", first).withColumn("bucket", F.explode(F.sequence(first, last))).drop("size", f"own_{side}")


def _split(many: DataFrame, few: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of hot buckets of ``many`` are dealt over several keys, and those of ``few`` copied to each of them."""
    place = [*on, "level", "bucket"]
    hot = many.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*place, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = many.join(hot, place, "left").withColumn("salt", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("parts")
    copied = few.join(hot, place, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt, copied


def overlaps(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """``on, l, r, relation`` of all pairs that share ``on`` (null matches nothing) and a point in time.

    Spans name the columns of start and end, whole numbers, both ends included; intervals with a null
    end or that end before they start meet nothing.  ``l`` and ``r`` are structs of the rows, ``relation`` is
    equal, inside (l within r), around (r within l) or overlap.  Rows that repeat pair as often.
    ``width``, the finest buckets, changes cost only: about the length of the short intervals.
    """
    spark = left.sparkSession
    keep = Scratch(spark, "intervals")
    a = keep.table(_levelled(left, on, *left_span, "l", width), "left")
    b = keep.table(_levelled(right, on, *right_span, "r", width), "right")
    levels = sorted({r.own for r in a.select(F.col("own_l").alias("own")).union(b.select("own_r")).distinct().collect()})  # LEVELS at most
    if not levels:
        levels = [0]
    place, out = [*on, "level", "bucket", "salt"], None
    for l_home in (True, False):
        # l at home and r at home or finer, then r at home and l finer; the side with the finer ones has the many rows
        x = _placed(a, "l", levels, width, l_home, not l_home)
        y = _placed(b, "r", levels, width, True, l_home)
        x, y = _split(y, x, on)[::-1] if l_home else _split(x, y, on)
        # a pair is told by the earliest bucket that both have
        met = x.join(y, place).where((F.col("bucket") == F.greatest("first_l", "first_r")) & (F.col("s_l") <= F.col("e_r")) & (F.col("s_r") <= F.col("e_l")))
        inside, around = (F.col("s_l") >= F.col("s_r")) & (F.col("e_l") <= F.col("e_r")), (F.col("s_r") >= F.col("s_l")) & (F.col("e_r") <= F.col("e_l"))
        relation = F.when(inside & around, "equal").when(inside, "inside").when(around, "around").otherwise("overlap")
        part = met.select(*on, "l", "r", relation.alias("relation"))
        out = part if out is None else out.unionByName(part)
    return out
