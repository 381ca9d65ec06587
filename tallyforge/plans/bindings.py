"""The driver tables as the relations of the evaluation model, for Spark and, as CTEs, for SQL.

metrics: one row per (example, strategy), the latest checkpoint of each.  attempts: provider
attempts, without token counts where the provider timed out.  candidates: answers in sequence
per example.  dims: what an example is about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows of a table in fewer parts than there are cores, dealt out before Python works on them; a table of many parts stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest checkpoint wins: one aggregate with partial combination, no window sort."""
    raw = table(spark, sf_dir, "lineitem")
    rest = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    latest = raw.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", *rest)).alias("m"))
    return latest.select(
        F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("strategy"), F.round(1 - F.col("m.l_discount") * 10, 2).alias("task_score"),
        (F.col("m.l_quantity") * 20).cast("long").alias("tokens"), F.col("m.l_extendedprice").alias("latency_ms"),
        F.col("m.l_returnflag").alias("cond"), F.col("m.l_linestatus").alias("status"), F.col("m.l_shipdate").alias("ended_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed_out = F.col("event_type") == "error"
    outcome = F.when(timed_out, "TIMEOUT").when(F.col("event_type") == "signup", "PARSE_ERROR_AFTER_RESPONSE").otherwise("SUCCESS")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("example_id"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("strategy"),
        "ts", outcome.alias("outcome"), F.when(~timed_out, F.floor("value")).alias("tokens_in"), F.when(~timed_out, F.floor(F.col("value") / 4)).alias("tokens_out"),
        F.floor(F.col("value") * 3).alias("latency_ms"), F.col("event_type").alias("kind"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("ts").cast("date").alias("day"), "event_id", F.col("event_type").alias("answer"), F.least(F.lit(1.0), F.round(F.col("value") / 500, 4)).alias("confidence"))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("o_orderkey").alias("example_id"), F.col("o_orderpriority").alias("difficulty"), F.col("c_mktsegment").alias("task"), F.col("n_name").alias("family"), F.col("r_name").alias("scenario"), F.col("o_orderstatus").alias("split"))


VIEWS = {"metrics": metrics, "attempts": attempts, "candidates": candidates, "dims": dims}

CTES = {
    "metrics": """metrics as (
  select l_orderkey as example_id, l_linenumber as strategy, round(1 - l_discount * 10, 2) as task_score,
    cast(l_quantity * 20 as bigint) as tokens, l_extendedprice as latency_ms, l_returnflag as cond, l_linestatus as status, l_shipdate as ended_at
  from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) as rn from lineitem) where rn = 1)""",
    "attempts": """attempts as (
  select event_id as attempt_id, user_id as example_id, cast(json_extract_string(props, '$.k') as bigint) % 5 as strategy, ts,
    case event_type when 'error' then 'TIMEOUT' when 'signup' then 'PARSE_ERROR_AFTER_RESPONSE' else 'SUCCESS' end as outcome,
    case when event_type <> 'error' then cast(floor(value) as bigint) end as tokens_in,
    case when event_type <> 'error' then cast(floor(value / 4) as bigint) end as tokens_out,
    cast(floor(value * 3) as bigint) as latency_ms, event_type as kind from events)""",
    "candidates": """candidates as (
  select user_id, cast(ts as date) as day, event_id, event_type as answer, least(1.0::double, round(value / 500, 4)) as confidence from events)""",
    "dims": """dims as (
  select o_orderkey as example_id, o_orderpriority as difficulty, c_mktsegment as task, n_name as family, r_name as scenario, o_orderstatus as split
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
