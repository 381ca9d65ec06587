"""Tables laid out by key: their plans hold no exchange, and their answers are those of plain tables."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import bindings as b
from tallyforge.sources import keyed

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    m = b.metrics(spark, DIR).select(F.col("strategy").alias("run_id"), "example_id", "task_score", "tokens")
    a = b.attempts(spark, DIR).select(F.col("strategy").alias("run_id"), "example_id", "attempt_id", F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"))
    plain = {
        "predictions": m.where("example_id % 10 <> 3").select(F.col("run_id").cast("long").alias("run_id"), "example_id", "task_score"),
        "metrics": m.select(F.col("run_id").cast("long").alias("run_id"), "example_id", F.inline(F.array(F.struct(F.lit("s").alias("metric"), F.col("task_score").alias("metric_value")), F.struct(F.lit("t").alias("metric"), F.lit(None).cast("double").alias("metric_value"))))),
        "attempts": a.select(F.col("run_id").cast("long").alias("run_id"), "example_id", "attempt_id", "input_tokens", "output_tokens"),
    }
    yield plain, {n: keyed.write_keyed(df, f"keyed_{n}", str(tmp_path / n), 6) for n, df in plain.items()}
    for n in plain:
        spark.sql(f"drop table if exists keyed_{n}")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange(spark, tables):
    plain, laid = tables
    got = keyed.observations(spark, "keyed_predictions", "keyed_metrics", "keyed_attempts")
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    lost = keyed.unreconciled(spark, "keyed_predictions", "keyed_attempts")
    assert "Exchange" not in plan(lost)
    keys = ["run_id", "example_id"]
    value = plain["metrics"].groupBy(*keys).agg(F.avg("metric_value"), F.count("metric_value"))
    used = plain["attempts"].groupBy(*keys).agg(F.count("*"), F.sum(F.expr("input_tokens + output_tokens")))
    want = plain["predictions"].join(value, keys, "left").join(used, keys, "left").fillna(0, ["count(metric_value)", "count(1)"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect()))) and got.count() == plain["predictions"].count()
    sides = {n: {tuple(r) for r in plain[n].select(*keys).collect()} for n in ("attempts", "predictions")}
    found = {(r.run_id, r.example_id, r.side) for r in lost.collect()}
    assert found == {(*k, "attempts") for k in sides["attempts"] - sides["predictions"]} | {(*k, "predictions") for k in sides["predictions"] - sides["attempts"]}
    assert len(laid["metrics"].inputFiles()) <= 6
