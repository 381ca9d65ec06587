"""Two large tables compared by trees of digests: only ranges of keys that differ are read row by row.

A range's digest is its number of rows and two sums of row hashes modulo 2^64, so the order of
rows doesn't matter, repeats count, and digests of ranges add up to the digest of the range
that holds them.  A tree of a table may be kept beside it; two trees are compared from the top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import Scratch

#: Keys of a leaf are alike but for LEAF bits, a node's children but for FAN bits.
LEAF, FAN = 12, 13
#: Levels above the leaves; the top has all keys of 64 bits in a few nodes.
LEVELS = 3
#: Runs of differing ranges up to which they are written into the scan's filter; more are joined.
RANGES = 256


def _hash(columns: list[str], salt: int) -> Column:
    """Of a row; hashing skips nulls, so a mask of them goes along."""
    mask = reduce(lambda a, c: a.bitwiseOR(c), [F.when(F.col(c).isNull(), F.lit(1 << (i % 60)).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(columns)])
    return F.xxhash64(F.lit(salt), mask, *columns).cast("decimal(20,0)")


def _sums(rows: DataFrame) -> DataFrame:
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    total = {h: F.pmod(F.sum(F.col(h).cast("decimal(38,0)")), whole).cast("decimal(20,0)").alias(h) for h in ("a", "b")}
    return rows.groupBy("level", "node").agg(F.sum("n").alias("n"), *total.values())


def leaves(df: DataFrame, key: str) -> DataFrame:
    """``level, node, n, a, b`` of each range of 2^LEAF keys; null keys make a range of their own, at a null node.

    Columns may be of any type but maps.  One partial aggregate, then one row for a range and task is shuffled.
    """
    columns = sorted(df.columns)
    rows = df.select(F.lit(0).alias("level"), F.shiftright(F.col(key).cast("long"), LEAF).alias("node"), F.lit(1).cast("long").alias("n"), _hash(columns, 1).alias("a"), _hash(columns, 2).alias("b"))
    return _sums(rows)


def tree(df: DataFrame, key: str) -> DataFrame:
    """``leaves`` and every level above them; the table is read once."""
    keep = Scratch(df.sparkSession, "digests")
    base = keep.table(leaves(df, key), "leaves")
    up = base.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))))
    up = up.withColumn("node", F.expr(f"shiftright(node, {FAN} * level)"))
    return keep.table(base.unionByName(_sums(up)), "tree")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``node`` of the leaves whose digests differ, or that one side lacks; below equal nodes nothing is looked at."""
    keep, found = Scratch(left.sparkSession, "differing"), None
    for k in range(LEVELS, -1, -1):
        a, b = (t.where(F.col("level") == k).select("node", F.struct("n", "a", "b").alias(name)) for t, name in ((left, "l"), (right, "r")))
        if found is not None:
            parents = found.withColumnRenamed("node", "parent")
            a, b = (t.join(parents, F.shiftright("node", FAN).eqNullSafe(F.col("parent")), "left_semi") for t in (a, b))
        both = a.join(b.withColumnRenamed("node", "other"), F.col("node").eqNullSafe(F.col("other")), "full_outer")
        found = keep.table(both.where(~F.col("l").eqNullSafe(F.col("r"))).select(F.coalesce("node", "other").alias("node")).distinct(), str(k))
    return found


def _runs(nodes: DataFrame) -> list[tuple[int, int]] | None:
    """First and last node of runs of neighbours; None if there are more than RANGES of them or many nodes."""
    some = sorted(r.node for r in nodes.where("node is not null").limit(16 * RANGES + 1).collect())
    starts = [x for i, x in enumerate(some) if i == 0 or some[i - 1] != x - 1]
    ends = [x for i, x in enumerate(some) if i + 1 == len(some) or some[i + 1] != x + 1]
    return list(zip(starts, ends, strict=True)) if len(some) <= 16 * RANGES and len(starts) <= RANGES else None


def _within(df: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Rows of the ranges: by a filter that the scan takes up where their runs are few, else by a join."""
    runs = _runs(nodes)
    if runs is None:
        return df.join(nodes, F.shiftright(F.col(key).cast("long"), LEAF).eqNullSafe(F.col("node")), "left_semi")
    tests = [F.col(key).between(lo << LEAF, ((hi + 1) << LEAF) - 1) for lo, hi in runs]
    if not nodes.where("node is null").isEmpty():
        tests.append(F.col(key).isNull())
    return df.where(reduce(lambda x, y: x | y, tests, F.lit(False)))


def compare(left: DataFrame, right: DataFrame, key: str, left_tree: DataFrame | None = None, right_tree: DataFrame | None = None) -> DataFrame:
    """``side`` ("left" or "right") and a row for each that this side has more often than the other, as often as it does.

    ``key`` is a column of whole numbers (any, null included, and not unique).  Both tables have the same
    columns.  Where trees are given the tables are only read where they differ.
    """
    nodes = differing(left_tree or tree(left, key), right_tree or tree(right, key))
    a, b = (_within(t.select(*sorted(left.columns)), key, nodes) for t in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
