"""Rows that no other row of their group beats in quality and cost at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.storage import Scratch


def front(cost: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Places of points that none costs as little as and is as good as, better in one; of equal points one."""
    order = np.lexsort((-quality, cost))
    best = np.maximum.accumulate(np.concatenate([[-np.inf], quality[order]]))[:-1]
    return order[quality[order] > best]


def _local(groups: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def reduced(t: pa.Table) -> pa.Table:
            keys = t.select(groups).combine_chunks().to_pandas() if groups else None
            number = keys.groupby(groups, dropna=False, sort=False).ngroup().to_numpy() if groups else np.zeros(len(t), int)
            cost, quality = t["cost"].to_numpy(), t["quality"].to_numpy()
            order = np.argsort(number, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(number[order])) + 1)
            return t.take(np.concatenate([p[front(cost[p], quality[p])] for p in parts]))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if len(t):
                held = reduced(t if held is None else pa.concat_tables([held, t]))
        if held is not None:
            yield from held.to_batches()

    return run


def nondominated(df: DataFrame, groups: list[str], quality: str, cost: str) -> DataFrame:
    """Rows of ``df`` for which no row of their group is as good and as cheap and better in one of both; equal rows stay together.

    Rows with a null or NaN in either are left out; null groups are a group.  Each task keeps the front of what it
    reads, which is short, so little is shuffled; the fronts' points meet in the order of cost, where
    a point stays if it is better than all that cost less.  The rows are then those at the points that stay.
    """
    keep = Scratch(df.sparkSession, "skyline")
    known = df.where(f"`{quality}` is not null and `{cost}` is not null and not isnan(`{quality}`) and not isnan(`{cost}`)")
    points = known.select(*groups, F.col(quality).cast("double").alias("quality"), F.col(cost).cast("double").alias("cost"))
    fronts = points.mapInArrow(_local(groups), points.schema)
    best = fronts.groupBy(*groups, "cost").agg(F.max("quality").alias("quality"))
    before = Window.partitionBy(*groups).orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("before", F.max("quality").over(before)).where("before is null or quality > before")
    kept = keep.table(kept.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("quality").alias("__q"), F.col("cost").alias("__c")), "points")
    on = (F.col(quality).cast("double") == F.col("__q")) & (F.col(cost).cast("double") == F.col("__c"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return known.join(kept, on, "left_semi")
