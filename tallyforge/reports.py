"""Reports over a store's relations, as DataFrames and as Markdown; the only module that formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.bootstrap import interval, statistics

#: Rows that a rendered table shows at most; more is said so.
SHOWN = 1000


def run_report(predictions: DataFrame, attempts: DataFrame, failures: DataFrame, rounds: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    """Of all runs at once: ``scores`` (summary and interval), ``metrics``, ``accounting`` and ``failures`` by run.

    predictions: run_id, example_id, task_score, tokens; attempts: run_id, logical_call_id, outcome, usage_status, tokens and
    latency; failures: run_id, label.
    """
    reported = F.col("usage_status") == "PROVIDER_REPORTED"
    known = F.when(reported, F.col("input_tokens") + F.col("output_tokens")).otherwise(0)
    return {
        "scores": statistics(predictions, "run_id", "example_id", "task_score", rounds, seed=seed),
        "metrics": predictions.groupBy("run_id").agg(F.avg("task_score").alias("mean_task_score"), F.avg("tokens").alias("mean_tokens"), F.count("*").alias("n")),
        "accounting": attempts.groupBy("run_id").agg(
            F.count_distinct("logical_call_id").alias("logical_calls"), F.count("*").alias("attempts"), F.count_if(F.col("outcome").isin("SUCCESS", "PARSE_ERROR_AFTER_RESPONSE")).alias("successful"),
            F.sum(known).alias("known_tokens"), F.when(F.bool_and(reported), F.sum(known)).alias("exact_tokens"), F.sum("latency_ms").alias("latency_ms"),
        ),
        "failures": failures.groupBy("run_id", "label").agg(F.count("*").alias("n")),
    }


def breakdown(rows: DataFrame, axes: list[str], value: str, key: str, rounds: int = 1000, tiny: int = 5) -> DataFrame:
    """``axis, name, n, mean, low, high, tiny`` of a value by each axis, tiny groups (below 5) marked; axes are read in one pass."""
    long = rows.select(key, value, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("name")) for a in axes])))
    long = long.withColumn("group", F.concat_ws("\t", "axis", F.coalesce("name", F.lit(""))))
    found = interval(long, "group", key, value, rounds)
    parts = F.split("group", "\t")
    return found.select(parts[0].alias("axis"), parts[1].alias("name"), "n", "mean", "low", "high", (F.col("n") < tiny).alias("tiny"))


def markdown(df: DataFrame, order: list[str] | None = None, digits: int = 4, most: int = SHOWN) -> str:
    """A table of at most ``most`` rows, in the order of all columns if no other is given; how many more there are is told."""
    rows = df.orderBy(*(order or df.columns)).limit(most + 1).collect()
    show = lambda x: "–" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(show(x) for x in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"\nMore than {most} rows; the table goes on."] if len(rows) > most else []))
