"""Readers and writers: JSON lines, run artifacts, file digests, SQLite stores, replayed providers and their replies."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

EXAMPLE = "id string, task_type string, language string, input string, gold string, metadata string"
# Error types by HTTP status, and those that a retry may help; fixed names.
ERRORS = {401: "AUTH_ERROR", 403: "AUTH_ERROR", 429: "RATE_LIMIT", 400: "INVALID_REQUEST", 413: "CONTEXT_LENGTH"}
RETRYABLE = ("RATE_LIMIT", "PROVIDER_UNAVAILABLE")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "[::1]")


def read_jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """Rows of JSON lines; a line that does not parse is in ``bad_line``, blank lines are skipped; ``path`` tells the file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("bad_line")
    return lines.select(F.from_json("value", schema).alias("r"), bad, F.input_file_name().alias("path")).select("r.*", "bad_line", "path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value`` of text files, lines counted from 1 within each file, however many tasks read it.

    A task's lines follow one another in its block of a file, so a line's number is its place there and the number of
    lines in the blocks before, of which there are few; the lines themselves are not shuffled by file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    starts = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["path", "block"]).select("path", (F.col("m") - F.col("first") + F.col("start") + 1).alias("line"), "value")


@F.pandas_udf(BooleanType())
def _readable(lines: pd.Series) -> pd.Series:
    def of(line: str) -> bool:
        try:
            json.loads(line)
        except ValueError:
            return False
        return True

    return lines.map(of)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, problem`` of lines that are no JSON, lines counted from 1 within each file.

    What the JVM's stricter parser takes is not looked at again; repeated keys and NaN are no problem.
    """
    doubtful = numbered_lines(spark, path).where("trim(value) <> '' and try_parse_json(value) is null")
    return doubtful.where(~_readable("value")).select("path", "line", F.concat_ws("", "path", F.lit(":"), "line", F.lit(": invalid JSON")).alias("problem"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids alone: no other field is parsed."""
    return spark.read.schema("id string").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, state`` of files (path, sha256) that were added, removed or changed; none means that all were preserved."""
    b, a = (df.select("path", F.col("sha256").alias(f"sha_{k}")) for k, df in (("b", before), ("a", after)))
    state = F.when(F.col("sha_b").isNull(), "added").when(F.col("sha_a").isNull(), "removed").when(F.col("sha_a") != F.col("sha_b"), "changed")
    return b.join(a, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def write_run(path: str, config: dict, predictions: DataFrame, metrics: DataFrame, attempts: DataFrame | None = None, failures: DataFrame | None = None, report: dict | None = None) -> list[str]:
    """A run's artifacts below ``path``; their names.

    predictions, attempts and failures as JSON lines, metrics (example_id, metric, value) long as Parquet and wide as
    CSV whose columns are the sorted names, config and report as JSON texts.
    """
    spark, made = predictions.sparkSession, []
    for name, df in (("predictions", predictions), ("attempts", attempts), ("failures", failures)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
            made.append(name)
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    names = sorted(r[0] for r in metrics.select("metric").distinct().collect())
    metrics.groupBy("example_id").pivot("metric", names).agg(F.first("value")).orderBy("example_id").write.mode("overwrite").csv(f"{path}/metrics_csv", header=True)
    made += ["metrics", "metrics_csv"]
    from tallyforge.functions.config import canonical

    for name, value in (("config", config), ("report", report)):
        if value is not None:
            spark.createDataFrame([(canonical(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
            made.append(name)
    return made


def write_progress(spark: SparkSession, path: str, state: dict) -> None:
    """Replace a small state file as a whole: written beside it, then renamed over it, so readers never see half of it."""
    from tallyforge.functions.config import canonical

    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(canonical(state).encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, target, how)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows_per_task: int = 100_000) -> DataFrame:
    """A table of a read-only SQLite store, by ranges of rowid in tasks; the path must exist on every executor.

    A store without the table is an error, as is a metrics table without metric_status, which older stores have.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[1] for r in db.execute(f'pragma table_info("{table}")')]
        if not names:
            raise ValueError(f"no table {table}")
        if table == "metrics" and "metric_status" not in names:
            raise ValueError("the store is of an older version: metrics lacks metric_status")
        low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{table}"').fetchone()
    listed = ", ".join(f'"{n}"' for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("id").to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    db.execute("pragma query_only = on")
                    rows = db.execute(f'select {listed} from "{table}" where rowid >= ? and rowid < ?', (start, start + rows_per_task)).fetchall()
                yield pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in rows], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = spark.createDataFrame([], schema).schema
    target = to_arrow_schema(kinds)
    return spark.range(low, high + 1, rows_per_task, numPartitions=max(1, (high - low) // rows_per_task + 1)).mapInArrow(run, kinds)


def federated(sources: dict[str, DataFrame], runs: dict[str, str], otherwise: str | None = None) -> DataFrame:
    """Rows of several stores, each run from the store that ``runs`` names, all other runs from ``otherwise``; ``source`` tells it."""
    parts = []
    for name, df in sources.items():
        own = [r for r, s in runs.items() if s == name]
        keep = F.col("run_id").isin(own) if own else F.lit(False)
        if name == otherwise:
            keep = keep | ~F.col("run_id").isin(list(runs))
        parts.append(df.where(keep).withColumn("source", F.lit(name)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def disagreeing(sources: list[DataFrame], key: str, payload: str, split: str = "dev") -> DataFrame:
    """``key, versions``: rows of a split that not all sources have alike; a row that a source lacks counts as another version."""
    tagged = [df.where(F.col("split") == split).select(key, payload, F.lit(k).alias("s")) for k, df in enumerate(sources)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    versions = F.count_distinct(payload) + F.when(F.count_distinct("s") < len(sources), 1).otherwise(0)
    return whole.groupBy(key).agg(versions.alias("versions")).where("versions > 1")


def replay(calls: DataFrame) -> DataFrame:
    """Answers of a replaying provider: call i gets output min(i, last) of its example (example_id, i, outputs).

    Without outputs a rule by ``role`` and ``mode`` (if they are columns) answers: a critic asks for no revision, the mode
    ``weak`` and cheap roles abstain, others answer nothing.
    """
    stated = F.element_at("outputs", F.least(F.col("i") + 1, F.size("outputs")).cast("int"))
    role, mode = (F.col(c) if c in calls.columns else F.lit("") for c in ("role", "mode"))
    ruled = (
        F.when(role == "critic", '{"needs_revision":false,"issues":[]}')
        .when((mode == "weak") | role.startswith("cheap"), '{"answer":"","citations":[],"abstain":true,"confidence":0.2}')
        .otherwise('{"answer":"","citations":[],"abstain":false,"confidence":0.5}')
    )
    return calls.withColumn("output", F.when(F.coalesce(F.size("outputs"), F.lit(0)) > 0, stated).otherwise(ruled))


def status_error(code: str = "status") -> Column:
    """``kind, retryable`` of an HTTP status."""
    c = F.col(code)
    known = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(known, c.cast("int")), F.when(c.between(500, 599), "PROVIDER_UNAVAILABLE").otherwise("UNKNOWN_PROVIDER_ERROR"))
    return F.struct(kind.alias("kind"), kind.isin(*RETRYABLE).alias("retryable"))


def url_class(url: str = "url") -> Column:
    """unspecified (null or empty), local or remote."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    return F.when(F.coalesce(F.col(url), F.lit("")) == "", "unspecified").when(host.isin(*LOCAL_HOSTS), "local").otherwise("remote")


def chat_response(body: str = "body", provider: str = "provider", rate_in: float = 0.0, rate_out: float = 0.0) -> Column:
    """``output, input_tokens, output_tokens, usage_source, cost, finish_reason, error`` of a chat completion's JSON.

    Usage that is missing is null, and so is its source; only ollama's own counters stand in for it.  A reply without
    choices is an error that no retry helps.
    """
    at = lambda path: F.get_json_object(body, path)
    stated = [at("$.usage.prompt_tokens").cast("long"), at("$.usage.completion_tokens").cast("long")]
    lacks = (F.col(provider) == "ollama") & (stated[0].isNull() | stated[1].isNull())
    tokens_in, tokens_out = (F.when(lacks, at(path).cast("long")).otherwise(s) for s, path in zip(stated, ("$.prompt_eval_count", "$.eval_count"), strict=True))
    known, has = tokens_in.isNotNull() & tokens_out.isNotNull(), at("$.choices[0]").isNotNull()
    return F.struct(
        F.when(has, F.coalesce(at("$.choices[0].message.content"), F.lit(""))).alias("output"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        F.when(known, "PROVIDER_REPORTED").alias("usage_source"), F.when(known, (tokens_in * rate_in + tokens_out * rate_out) / 1000).otherwise(0.0).alias("cost"),
        F.when(has, F.coalesce(at("$.choices[0].finish_reason"), F.lit("stop"))).alias("finish_reason"), F.when(~has, "UNKNOWN_PROVIDER_ERROR").alias("error"),
    )
