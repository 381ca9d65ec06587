"""Sketches that are kept for each run and day and merged into any roll-up: distinct values, quantiles, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithms of sizes: HyperLogLog's registers, the theta sketch's hashes; the quantile sketch's k.
HLL, THETA, KLL = 14, 14, 400


def sketch(df: DataFrame, by: list[str], item: str, number: str) -> DataFrame:
    """``by, n, items, cohort, numbers`` of each group: rows, sketches of distinct ``item`` (to count, to intersect) and of ``number``.

    Items are longs or texts; nulls of either are in no sketch.  One partial aggregate; a sketch is of bounded size.
    """
    numbers = F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(KLL))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, HLL).alias("items"), F.theta_sketch_agg(item, THETA).alias("cohort"), numbers.alias("numbers"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of a coarser grouping, from those of a finer one alone."""
    union = (F.hll_union_agg("items").alias("items"), F.theta_union_agg("cohort", THETA).alias("cohort"), F.kll_merge_agg_double("numbers", F.lit(KLL)).alias("numbers"))
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *union)


def distinct() -> Column:
    return F.hll_sketch_estimate("items")


def quantile(rank: float) -> Column:
    return F.kll_sketch_get_quantile_double("numbers", F.lit(rank))


def shared(a: str, b: str) -> Column:
    """Estimated number of items that two cohorts have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
