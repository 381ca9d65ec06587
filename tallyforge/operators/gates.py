"""Whether runs may be compared at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of sets that must be equal over all runs, and the experiments' columns that make them.
EQUAL = {
    "DATASET_HASH_MISMATCH": "dataset_hash", "BENCHMARK_VERSION_MISMATCH": "version", "BUDGET_MODE_MISMATCH": "mode", "TOKEN_BUDGET_MISMATCH": "max_total_tokens",
    "CALL_BUDGET_MISMATCH": "max_calls", "COST_BUDGET_MISMATCH": "max_cost",
}
#: What a critic's prompt version carries behind the task's; other roles' versions stay as they are.
CRITIC = r"\.critic-contract\.v1$"


def _differ(c: str) -> Column:
    """More than one value; a missing one is a value too."""
    return F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) > 1


def _set_digest(c: Column) -> Column:
    """Of a few values."""
    return F.md5(F.to_json(F.array_sort(F.collect_set(c))))


def _many_digest(c: Column) -> Column:
    """Of any number of values: their hashes add up in any order, and nothing is gathered."""
    return F.sum_distinct(F.xxhash64(c).cast("decimal(20,0)")).cast("string")


def compatibility(runs: DataFrame, experiments: DataFrame, attempts: DataFrame, predictions: DataFrame, examples: DataFrame, group: str) -> DataFrame:
    """``group, ok, codes`` for each set of runs to be compared (runs of one ``group``).

    Every run must be complete, have an experiment and have all usage known; all must agree in dataset, version, examples,
    splits, tasks, budgets (an absent ceiling is a ceiling of its own), prompt versions and, where one asks for it,
    models; budgets must hold per example.  A set with a missing experiment gets no codes of agreement.  Sets are
    compared by digests that are made per run, so one row a run meets.
    """
    used = attempts.groupBy("run_id").agg(
        F.bool_or((F.col("usage_status") == "UNKNOWN_NOT_RETURNED") | F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).alias("unknown"),
        (F.bool_or(F.col("retry_count") > 0) if "retry_count" in attempts.columns else F.lit(False)).alias("legacy"),
        _set_digest(F.when(F.col("role") == "critic", F.regexp_replace("prompt_version", CRITIC, "")).otherwise(F.col("prompt_version"))).alias("prompts"),
    )
    done = predictions.select("run_id", "example_id").join(examples.select("example_id", "split", "task"), "example_id")
    seen = done.groupBy("run_id").agg(_many_digest(F.col("example_id")).alias("examples"), _set_digest(F.col("split")).alias("splits"), _set_digest(F.col("task")).alias("tasks"))
    known = experiments.withColumn("known", F.lit(True))
    rows = runs.join(known, "experiment_id", "left").join(used, "run_id", "left").join(seen, "run_id", "left")
    missing = F.bool_or(F.col("known").isNull())
    always = {
        "UNKNOWN_USAGE_ACCOUNTING": F.bool_or(F.coalesce("unknown", F.lit(False))), "INCOMPLETE_RETRY_ATTEMPT_ACCOUNTING": F.bool_or(F.coalesce("legacy", F.lit(False))),
        "INCOMPLETE_RUN": F.bool_or(F.col("status") != "COMPLETED"), "MISSING_EXPERIMENT": missing,
    }
    agree = {code: _differ(c) for code, c in EQUAL.items()} | {
        "EXAMPLE_SET_MISMATCH": _differ("examples"), "SPLIT_MISMATCH": _differ("splits"), "TASK_FAMILY_MISMATCH": _differ("tasks"), "PROMPT_VERSION_MISMATCH": _differ("prompts"),
        "BUDGET_SCOPE_MISMATCH": F.bool_or(F.col("scope") != "PER_EXAMPLE"), "MODEL_CONSTRAINT_MISMATCH": F.bool_or(F.col("same_models")) & _differ("model_group"),
    }
    rules = always | {code: rule & ~missing for code, rule in agree.items()}
    found = rows.groupBy(group).agg(F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()])).alias("codes"))
    return found.select(group, (F.size("codes") == 0).alias("ok"), F.array_sort("codes").alias("codes"))
