"""Store tables laid out by example: bucketed and sorted by (run_id, example_id), so joins and groupings by it shuffle nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("run_id", "example_id")


def write_keyed(df: DataFrame, name: str, path: str, buckets: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Save a table of the session's catalog below ``path``, one file for each bucket, sorted within; its rows.

    All tables that are to meet must have the same number of buckets: about the store's bytes / 256 MB.  Rows are dealt to
    buckets by Spark's own hash first, so a task writes one bucket.  A table of that name is replaced.  A hot key fills one
    bucket, as it would fill one task of a shuffle.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def observations(spark: SparkSession, predictions: str, metrics: str, attempts: str) -> DataFrame:
    """A row for each prediction with its mean metric value, number of attempts and tokens; tables by name, of ``write_keyed``.

    The groupings and joins run bucket by bucket, without an exchange.
    """
    value = spark.table(metrics).groupBy(*KEYS).agg(F.avg("metric_value").alias("mean_value"), F.count("metric_value").alias("n_metrics"))
    used = spark.table(attempts).groupBy(*KEYS).agg(F.count("*").alias("attempts"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    rows = spark.table(predictions).hint("merge").join(value.hint("merge"), list(KEYS), "left").join(used.hint("merge"), list(KEYS), "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_metrics", "attempts")})


def unreconciled(spark: SparkSession, predictions: str, attempts: str) -> DataFrame:
    """``run_id, example_id, side`` of examples with attempts but no prediction, or the other way round; nothing is shuffled."""
    tried, done = (spark.table(t).select(*KEYS).distinct() for t in (attempts, predictions))
    lost = tried.join(done.hint("merge"), list(KEYS), "left_anti").withColumn("side", F.lit("attempts"))
    return lost.unionByName(done.join(tried.hint("merge"), list(KEYS), "left_anti").withColumn("side", F.lit("predictions")))
