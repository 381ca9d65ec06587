"""A result store on append-only tables: upserts, guards and audits without row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.commits import Log


def latest(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last writer wins: one aggregate with partial combination; a missing value replaces too."""
    rest = [c for c in log.columns if c not in (*keys, seq)]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.max(seq).alias(seq))
    return best.select(*keys, seq, "r.*").select(*log.columns)


def finished_first(log: DataFrame, keys: list[str], seq: str, outcome: str) -> DataFrame:
    """The first finished row of a key is immutable; a started one counts only without it."""
    rank = F.struct((F.col(outcome) == "STARTED").cast("int").alias("started"), F.col(seq).alias("seq"))
    best = log.groupBy(*keys).agg(F.min_by(F.struct(*log.columns), rank).alias("r"))
    return best.select("r.*")


def conflicting(log: DataFrame, keys: list[str], outcome: str, payload: list[str]) -> DataFrame:
    """Keys whose finished rows differ: a replay must be identical."""
    done = log.where(F.col(outcome) != "STARTED")
    return done.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).alias("versions")).where("versions > 1")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def metric_status(value: str = "value") -> Column:
    return F.when(F.col(value).isNull(), "UNSCORABLE_FAILED_OUTPUT").otherwise("SCORED")


def bijection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only; an empty result means the sets are equal."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, keys, "full_outer").where("in_a is null or in_b is null")


def finish(log: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``log`` with the columns that ``updates`` (key and some columns) states; a null there leaves what was."""
    names = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    joined = log.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in log.columns])


def logical_calls(log: DataFrame, key: str, seq: str, mutable: list[str]) -> DataFrame:
    """One row per call: its first row, with the ``mutable`` columns of its last one."""
    fixed = [c for c in log.columns if c not in (key, seq, *mutable)]
    one = log.groupBy(key).agg(F.min_by(F.struct(*fixed), seq).alias("f"), F.max_by(F.struct(*mutable), seq).alias("m"), F.max(seq).alias(seq))
    return one.select(key, seq, "f.*", "m.*").select(*log.columns)


def insert_unique(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` and ``rows``; raises if a key would stand twice."""
    twice = duplicates(rows.select(*keys).unionByName(stored.select(*keys).join(rows.select(*keys).distinct(), keys, "left_semi")), keys).limit(5).collect()
    if twice:
        raise ValueError(f"keys stand already: {[tuple(r)[:-1] for r in twice]}")
    return stored.unionByName(rows)


def checkpoint(predictions: DataFrame, metrics: DataFrame, failures: DataFrame, path: str, batch: int) -> int:
    """Commit an example batch's predictions, metrics (with their status) and failures as one; the store's version.

    Readers (``commits.Log(spark, path).read("metrics")``) see all three or none, and a batch that is written again changes nothing.
    """
    tables = {"predictions": predictions, "metrics": metrics.withColumn("metric_status", metric_status("metric_value")), "failures": failures}
    return Log(predictions.sparkSession, path).commit(tables, token=str(batch))


def evaluate_pending(predictions: DataFrame, evaluated: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Predictions after, and the metrics to append of, an evaluation (keys, payload, metrics array<struct<metric,value>>).

    Only predictions that are PENDING and whose payload is the evaluated one become EVALUATED; others stay, and get no
    metrics.
    """
    e = evaluated.select(*keys, F.col("payload").alias("__p"), "metrics")
    joined = predictions.join(e, keys, "left").withColumn("__go", (F.col("status") == "PENDING") & F.col("payload").eqNullSafe(F.col("__p")) & F.col("metrics").isNotNull())
    after = joined.withColumn("status", F.when(F.col("__go"), "EVALUATED").otherwise(F.col("status"))).select(*predictions.columns)
    return after, joined.where("__go").select(*keys, F.inline("metrics"))


def failed_predictions(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, attempt_ids, primary, errors, valid`` of trajectories with parse failures (attempt_id, logical_call_id, outcome, usage_status, error).

    Failures come in the order of attempts, the first is the primary one; ``valid`` tells that all usage was reported and
    every logical call has one attempt.
    """
    failed = F.col("outcome") == "PARSE_ERROR_AFTER_RESPONSE"
    found = attempts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(failed, F.struct("attempt_id", "error")))).alias("f"),
        (F.bool_and(F.col("usage_status") == "PROVIDER_REPORTED") & (F.count("*") == F.count_distinct("logical_call_id"))).alias("valid"),
    )
    found = found.where(F.size("f") > 0)
    return found.select(*keys, F.col("f.attempt_id").alias("attempt_ids"), F.get("f", F.lit(0))["attempt_id"].alias("primary"), F.col("f.error").alias("errors"), "valid")


def manifest(files: DataFrame, version: str) -> DataFrame:
    """``name, sha256, length, version`` of frozen files (path, sha256, length)."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "length", F.lit(version).alias("version"))


def verify_manifest(frozen: DataFrame, files: DataFrame) -> DataFrame:
    """``name, problem`` of files that are missing, not in the manifest or of another digest; none means that all is as frozen."""
    now = manifest(files, "").select("name", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNLISTED").when(F.col("now") != F.col("sha256"), "DIGEST_MISMATCH")
    return frozen.select("name", "sha256").join(now, "name", "full_outer").select("name", problem.alias("problem")).where("problem is not null")


def resume_gate(runs: DataFrame, attempts: DataFrame, checkpoints: DataFrame, cohort: DataFrame) -> DataFrame:
    """``run_id, problems`` for each run: what speaks against resuming it.

    Its attempts must be finished and of known usage, and its checkpoints (run_id, example_id, place) the first ones of the
    cohort (example_id, place) in its order.
    """
    used = attempts.groupBy("run_id").agg(F.bool_or(F.col("outcome") == "STARTED").alias("unfinished"), F.bool_or(F.col("usage_status") == "UNKNOWN_NOT_RETURNED").alias("unknown"))
    placed = checkpoints.join(cohort.select("example_id", F.col("place").alias("due")), "example_id", "left")
    order = placed.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("place") == F.col("due"), F.lit(False))).alias("prefix"))
    joined = runs.join(used, "run_id", "left").join(order, "run_id", "left")
    rules = {"RUN_COMPLETED": F.col("status") == "COMPLETED", "UNFINISHED_ATTEMPTS": F.col("unfinished"), "UNKNOWN_USAGE": F.col("unknown"), "CHECKPOINTS_OUT_OF_ORDER": ~F.col("prefix")}
    return joined.select("run_id", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])).alias("problems"))
