"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, keep: Scratch, label: str = "cc") -> DataFrame:
    """``node, root``: the least node of each node's component, for nodes of edges ``u, v``.

    In the end each edge leads from a node to its root.  A round takes four shuffles of the
    edges; the number of rounds grows with the logarithm of the components' size.  The driver
    sees a count and a checksum of the edges, no more.  Self loops and repeats do no harm.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = keep.table(e, f"{label}-0")
    state, k = _state(e), 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        k += 1
        e = keep.table(small, f"{label}-{k}")
        keep.drop(f"{label}-{k - 1}")
        state, last = _state(e), state
        if state == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
