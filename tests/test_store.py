"""Writes of the store, streams of attempts and the generated corpus."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import quality, scoring, store
from tallyforge.sources.commits import Conflict, Log
from tallyforge.sources import corpus, files
from tallyforge.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_writes(spark, tmp_path):
    runs = spark.createDataFrame([("a", "RUNNING", None), ("b", "RUNNING", 1)], "id string, status string, n int")
    assert rows(store.finish(runs, spark.createDataFrame([("a", "COMPLETED", None)], "id string, status string, n int"), "id")) == [("a", "COMPLETED", None), ("b", "RUNNING", 1)]
    calls = spark.createDataFrame([(1, 1, "x", "STARTED"), (1, 2, "y", "SUCCESS")], "id int, seq int, role string, outcome string")
    assert rows(store.logical_calls(calls, "id", "seq", ["outcome"])) == [(1, 2, "x", "SUCCESS")]
    assert store.insert_unique(runs, runs.withColumn("id", F.concat("id", F.lit("2"))), ["id"]).count() == 4
    for bad in (runs, runs.unionByName(runs)):
        with pytest.raises(ValueError):
            store.insert_unique(runs.limit(0) if bad is not runs else runs, bad, ["id"])
    m = spark.createDataFrame([(1, "f1", None), (1, "em", 1.0)], "example_id int, metric string, metric_value double")
    stored = Log(spark, str(tmp_path / "cp"))
    for _ in range(2):
        store.checkpoint(runs, m, runs.limit(0), str(tmp_path / "cp"), 3)
    assert stored.read("predictions").count() == 2 and stored.read("failures").isEmpty() and stored.version() == 1
    assert rows(stored.read("metrics").select("metric", "metric_status")) == [("em", "SCORED"), ("f1", "UNSCORABLE_FAILED_OUTPUT")]
    p = spark.createDataFrame([(1, "PENDING", "x"), (2, "PENDING", "y"), (3, "EVALUATED", "z")], "id int, status string, payload string")
    e = spark.createDataFrame([(1, "x", [("f1", 1.0)]), (2, "other", [("f1", 1.0)]), (3, "z", [("f1", 1.0)])], "id int, payload string, metrics array<struct<metric:string,value:double>>")
    after, new = store.evaluate_pending(p, e, ["id"])
    assert rows(after.select("id", "status")) == [(1, "EVALUATED"), (2, "PENDING"), (3, "EVALUATED")] and rows(new) == [(1, "f1", 1.0)]


def test_audits(spark, tmp_path):
    a = spark.createDataFrame([(1, 5, 50, "PARSE_ERROR_AFTER_RESPONSE", "PROVIDER_REPORTED", "e2"), (1, 4, 40, "PARSE_ERROR_AFTER_RESPONSE", "PROVIDER_REPORTED", "e1"), (2, 6, 60, "SUCCESS", "PROVIDER_REPORTED", None)], "id int, attempt_id int, logical_call_id int, outcome string, usage_status string, error string")
    assert rows(store.failed_predictions(a, ["id"])) == [(1, [4, 5], 4, ["e1", "e2"], True)]
    for name, text in (("x", "1"), ("y", "2")):
        (tmp_path / name).write_text(text)
    listed = files.file_sha256(spark, str(tmp_path / "*"))
    frozen = spark.createDataFrame(store.manifest(listed, "v1").collect())
    assert store.verify_manifest(frozen, listed).isEmpty()
    (tmp_path / "y").write_text("3")
    (tmp_path / "z").write_text("4")
    (tmp_path / "x").unlink()
    assert rows(store.verify_manifest(frozen, files.file_sha256(spark, str(tmp_path / "*")))) == [("x", "MISSING"), ("y", "DIGEST_MISMATCH"), ("z", "UNLISTED")]
    runs = spark.createDataFrame([(1, "RUNNING"), (2, "COMPLETED"), (3, "FAILED")], "run_id int, status string")
    att = spark.createDataFrame([(1, "SUCCESS", "PROVIDER_REPORTED"), (3, "STARTED", "UNKNOWN_NOT_RETURNED")], "run_id int, outcome string, usage_status string")
    cohort = spark.createDataFrame([("a", 1), ("b", 2)], "example_id string, place int")
    done = spark.createDataFrame([(1, "a", 1), (3, "b", 1)], "run_id int, example_id string, place int")
    assert rows(store.resume_gate(runs, att, done, cohort)) == [(1, []), (2, ["RUN_COMPLETED"]), (3, ["UNFINISHED_ATTEMPTS", "UNKNOWN_USAGE", "CHECKPOINTS_OUT_OF_ORDER"])]


def test_streams_of_attempts(spark, tmp_path):
    t = lambda m: f"2026-01-01 00:{m:02d}:00"
    first = [("a1", 1, t(1), 10.0), ("a1", 1, t(1), 10.0), ("a2", 1, t(2), 5.0)]
    second = [("a2", 1, t(2), 5.0), ("a3", 1, t(40), 1.0)]
    late = [("a4", 1, t(3), 7.0), ("a5", 1, t(58), 2.0)]
    schema = "attempt_id string, user_id int, ts string, value double"
    for i, part in enumerate((first, second, late)):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windows.distinct_attempts(stream, "attempt_id", "ts", "30 minutes").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.attempt_id for r in spark.table("once").collect()]
    assert len(got) == len(set(got)) and {"a1", "a2", "a3", "a5"} <= set(got)
    sink = windows.checkpoint_stream(stream, str(tmp_path / "out"), ["attempt_id"], "ts", str(tmp_path / "c2")).trigger(availableNow=True).start()
    sink.awaitTermination(120)
    stored = windows.read_checkpoints(spark, str(tmp_path / "out"), ["attempt_id"], "ts")
    assert sorted(r.attempt_id for r in stored.collect()) == ["a1", "a2", "a3", "a4", "a5"]
    batch = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for kind in ("sliding", "session"):
        assert sum(r.attempts for r in windows.accounting(batch, "user_id", "ts", "value", kind, "10 minutes", "5 minutes").collect()) >= batch.count()


def test_generated_corpus_is_clean(spark):
    c = corpus.build(spark)
    assert c.count() == 480 == c.select("id").distinct().count()
    split = F.get_json_object("metadata", "$.split")
    assert {r[0]: r[1] for r in c.groupBy(split).count().collect()} == {"test": 200, "dev": 280}
    level = {r[0]: r[1] for r in c.groupBy(F.get_json_object("metadata", "$.difficulty")).count().collect()}
    assert level == {"easy": 144, "medium": 144, "hard": 192}
    found = quality.example_issues(c)
    assert found.isEmpty(), found.groupBy("rule", "issue").count().collect()
    assert quality.split_leaks(c).isEmpty() and quality.collection_issues(c).first().issues == []
    right = c.withColumn("output", F.when(F.col("task_type") == "structured_extraction", F.get_json_object("gold", "$.expected")).when(F.col("task_type") == "business_summarization", F.col("gold")).otherwise(
        F.to_json(F.struct(F.get_json_object("gold", "$.answer").alias("answer"), F.array(F.lit("e1"), F.lit("e2")).alias("citations"), F.lit(False).alias("abstain"), F.lit(0.9).alias("confidence")))))
    assert {r.task_score for r in scoring.task_scores(right).select("task_score").distinct().collect()} == {1.0}


def test_a_commit_is_all_or_nothing(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path / "log"))
    one, two = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(1, 0.5)], "id int, v double")
    assert log.version() == 0 and log.commit({"p": one, "m": two}, token="b1") == 1

    def broken(*_):
        raise OSError("lost")

    bad = two.withColumn("v", F.raise_error(F.lit("lost")))
    for tables in ({"p": one, "m": bad}, {"m": bad, "p": one}):
        with pytest.raises(Exception, match="lost"):
            log.commit(tables, token="b2")
    with monkeypatch.context() as m:
        m.setattr(Log, "_publish", broken)
        with pytest.raises(OSError):
            log.commit({"p": one, "m": two}, token="b2")
    assert log.version() == 1 and log.read("p").count() == log.read("m").count() == 1
    assert log.commit({"p": one, "m": two}, token="b2") == 2 == log.commit({"p": one, "m": two}, token="b2") and log.read("p").count() == 2
    assert log.read("p", 1).count() == 1
    assert log.commit(replace={"p": one.limit(0)}) == 3 and log.read("p").isEmpty() and log.read("m").count() == 2
    with pytest.raises(Conflict):
        log.commit(replace={"p": one}, base=2)
    with pytest.raises(ValueError):
        log.commit({"p": two})
    log.compact("m")
    assert log.read("m").count() == 2 and len(log.state()["m"]["batches"]) == 1 and log.commit({"m": two}, token="b1") == 4
    assert len(log.vacuum(0, 1)) > 0 and log.read("m").count() == 2 and log.versions() == [4]


def test_concurrent_writers(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([(1,)], "id int")
    base = log.commit({"p": one})

    def add(_):
        return log.commit({"p": one})

    def swap(k):
        try:
            return log.commit(replace={"p": one.withColumn("id", F.lit(k))}, base=base + 6)
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        assert sorted(pool.map(add, range(6))) == list(range(base + 1, base + 7)) and log.read("p").count() == 7
        won = [x for x in pool.map(swap, range(6)) if x]
    assert won == [base + 7] and log.read("p").count() == 1


def test_progress_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "state.json")
    for k in range(3):
        files.write_progress(spark, path, {"k": k})
        assert json.loads(open(path).read()) == {"k": k}
