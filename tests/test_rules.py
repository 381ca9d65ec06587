"""Golden cases of scoring, configuration, sources, ledgers and selections."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import config as cfg
from tallyforge.functions import ledger as lg
from tallyforge.functions import outputs as o
from tallyforge.functions import routing
from tallyforge.functions import text as t
from tallyforge.operators import ledger, mechanisms, selection, similarity
from tallyforge.sources import files


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_normalisers_in_both_forms(spark):
    numbers = ["150万円", "1,500,000円", "約2.5千円", "abc", "１５０万円", "true", None]
    assert [o.number(x) for x in numbers] == [1500000, 1500000, 2500, None, 1500000, None, None] == values(spark, t.normalize_number, *numbers)
    dates = ["令和8年4月1日", "2026/4/1", "2026年13月45日", "2026-02-30", None, " ABC ", "on 2026年4月1日."]
    want = ["2026-04-01", "2026-04-01", "2026-13-45", "2026-02-30", "none", "abc", "2026-04-01"]
    assert [o.date(x) for x in dates] == want == values(spark, t.normalize_date, *dates)
    texts = ['a"b\\c\n', "a\u0001b", "日本", ""]
    assert values(spark, t.estimate_tokens, *texts) == [max(1, (len(json.dumps(x, ensure_ascii=False)) + 3) // 4) for x in texts]


def test_scores():
    assert o.normal(" 30日前 ") == o.normal("30日前") and o.token_f1("契約更新", "契約") == pytest.approx(2 / 3)
    assert o.citations(["a", "b"], ["b", "c"]) == (0.5, 0.5, 0.5) and o.citations([], []) == (1, 1, 1) and o.citations([], ["a"]) == (0, 0, 0) == o.citations(["a"], [])
    schema = {"type": "object", "required": ["amount_jpy"], "additionalProperties": False, "properties": {"amount_jpy": {"type": "integer"}, "issue_date": {"type": "string", "format": "date"}}}
    gold = {"expected": {"amount_jpy": 1500000, "issue_date": "2026-04-01"}, "json_schema": schema}
    got = o.score("structured_extraction", {}, gold, {}, {"amount_jpy": "150万円", "issue_date": "令和8年4月1日", "extra": 1})
    assert (got["json_schema_validity"], got["numeric_field_accuracy"], got["date_field_accuracy"], got["hallucinated_field_count"], got["task_score"]) == (0, 1, 1, 1, 0.75)
    assert o.score("structured_extraction", {}, {"expected": {"amount_jpy": None}, "json_schema": schema}, {}, {"amount_jpy": "abc"})["numeric_field_accuracy"] == 1
    failed = o.evaluate("grounded_qa", {}, {"answer": "x"}, {}, "no json")
    assert failed["json_parse_success"] == failed["schema_compliance"] == failed["task_score"] == 0 and failed["exact_match"] is None
    assert set(o.COMPONENTS["grounded_qa"]) <= failed.keys()
    assert o.evaluate("grounded_qa", {}, {"answer": "x", "acceptable_answers": 3}, {}, '{"answer": 1}', failed=True)["exact_match"] is None


def test_types_and_replies():
    assert o.is_type(True, "boolean") and not o.is_type(True, ["integer", "number"]) and o.is_type(None, ["string", "null"]) and not o.is_type("x", "text")
    assert o.parse_output('x {"a": 1} y') == ("REPAIRED", {"a": 1}) and o.parse_output("[1]") == ("PARSE_ERROR", None) and o.parse_output("} {") == ("PARSE_ERROR", None)
    assert o.parse_critic('```json\n{"needs_revision": true, "issues": ["x"]}\n```') == (True, ["x"], None)
    assert o.parse_critic('so: {"needs_revision": false, "issues": []} and {more') == (False, [], None)
    assert o.parse_critic('{"needs_revision": 1, "issues": []}')[2] and o.parse_critic('{"needs_revision": true}')[2] and o.parse_critic(None)[2] == "malformed JSON"


def test_route_of_the_hard_case():
    f = routing.features("grounded_qa", {"evidence_units": [{"id": 1}]}, {}, {"difficulty": "hard"}, {"answer": "x", "confidence": 0.35}, 0.35, "m")
    assert routing.uncertainty(f) == pytest.approx(0.795) and routing.route(0.795) == "debate"
    with pytest.raises(ValueError):
        routing.check_names(("gold_answer",))


def test_ledger_keeps_an_overrun_and_blocks_what_follows():
    ledger_ = lg.Ledger(lg.Limits(total=252))
    assert ledger_.admission(100, 400) == (None, 152)
    assert ledger_.complete(100, 153, 1.0, 0.0) == ["total"] and ledger_.summary()["overrun_tokens"] == 1
    assert ledger_.admission(1, 1)[0] == "overrun" and not ledger_.may_call() and ledger_.remaining()["total"] == 0
    stopped = lg.Ledger(lg.Limits())
    stopped.complete(None, 3, 0.0, 0.0)
    assert stopped.admission(0, None)[0] == "unknown_usage" and stopped.summary()["exact_total"] is None


def test_ledger_stream_decides_like_the_batch(spark, tmp_path):
    limits = lg.Limits(calls=5, total=300, output=90)
    rows = [(k, i, (k * 7 + i * 13) % 60, None if i % 3 else 50, None if (k + i) % 11 == 10 else i * 9, i * 5, 1.0, 0.0, True) for k in range(6) for i in range(8)]
    schema = "key long, seq long, estimate long, most_output long, input long, output long, latency double, cost double, reported boolean"
    calls = spark.createDataFrame(rows, schema)
    batch = {r.key: [(d.rejected, d.cap, list(d.violations)) for d in r.decisions] for r in ledger.replay(calls, ["key"], ["seq"], limits).collect()}
    for part in (0, 1):
        calls.where(F.floor(F.col("seq") / 4) == part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = ledger.replay_stream(stream, "key", limits).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("decided").orderBy("key", "seq").collect():
        got.setdefault(r.key, []).append((r.rejected, r.cap, list(r.violations)))
    assert got == batch


def test_votes(spark):
    said = [("不明", 0.3), ("30日前", 0.8), ("30日前", 0.7), ("不明", 0.2)]
    rows = [(1, [(json.dumps({"answer": a}, ensure_ascii=False), c) for a, c in said]), (2, [('{"a":1,"b":2}', 0.5), ('{"b":2,"a":1}', 0.5)]), (3, [('{"answer":"x"}', 0.5), ('{"answer":"x","abstain":false}', 0.5), ('{"answer":"x","abstain":true}', 0.5)])]
    df = spark.createDataFrame(rows, "id int, candidates array<struct<output:string,confidence:double>>")
    got = {r.id: (r.n, r.answers, r.tie, r.selected) for r in mechanisms.votes(df, ["id"]).collect()}
    assert got == {1: (4, 2, True, 1), 2: (2, 1, False, 0), 3: (3, 2, False, 0)}


def test_pilot_is_the_plain_loop(spark):
    rows = [(f"t{i % 2}", ("easy", "medium", "hard")[i % 3], f"s{i * 7 % 4}", f"r{i * 5 % 6}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "task string, difficulty string, surface string, reasoning string, id long")
    want = {task: selection.greedy([r[1:] for r in rows if r[0] == task], selection.TARGETS, ("r3", "r1")) for task in ("t0", "t1")}
    got = {}
    for r in selection.pilot(df, priority=("r3", "r1")).orderBy("task", "place").collect():
        got.setdefault(r.task, []).append(r.id)
    assert got == want and all(len(x) == 8 for x in got.values())
    assert [r.id for r in selection.smoke(df).orderBy("task").collect()] == [min((r[1] != "easy", r[3], r[4]) for r in rows if r[0] == task)[2] for task in ("t0", "t1")]


def test_near_pairs_against_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghij ", k=rng.randint(0, 90))) for _ in range(40)]
    texts += [x[:k] + "Z" + x[k + 1 :] for x in texts[:20] for k in (5,)] + [texts[0], "", ""]
    rows = [(i, x, f"b{i % 2}", i % 3) for i, x in enumerate(texts)] + [(900, None, "b0", 0)]
    df = spark.createDataFrame(rows, "id int, text string, block string, side int")
    for least in (0.9, 0.97):
        alike = lambda a, b: round(difflib.SequenceMatcher(None, a[1], b[1]).ratio(), 4)
        want = sorted((a[0], b[0], alike(a, b)) for a in rows for b in rows if a[3] < b[3] and None not in (a[1], b[1]) and a[2] == b[2] and alike(a, b) >= least)
        got = sorted((r.id_a, r.id_b, r.ratio) for r in similarity.near_pairs(df, least, "block", "side").collect())
        assert got == want and want


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": "${HERE}/x", "b": ["${NOT_THERE}"], "n": 1}')
    assert cfg.resolve_env(json.loads((tmp_path / "c.json").read_text()), {"HERE": "h"}) == {"a": "h/x", "b": ["${NOT_THERE}"], "n": 1}
    assert cfg.load_config(str(tmp_path / "c.json"), env=False)["n"] == 1
    assert cfg.stable_hash({"b": 1, "a": "é"}) == cfg.stable_hash({"a": "é", "b": 1})
    assert cfg.redact({"x": {"OPENAI_API_KEY": "k"}, "token": ["t"], "tokens": 3}) == {"x": {"OPENAI_API_KEY": "***REDACTED***"}, "token": "***REDACTED***", "tokens": 3}
    assert cfg.budget({"budget": {"max_calls": 3, "max_total_tokens": None}})["max_total_tokens"] == 8000 and cfg.budget({"budget": {"max_calls": 3}})["max_calls"] == 3
    with pytest.raises(ValueError):
        cfg.budget({"budget_policy": {"mode": "MATCHED_ESTIMATED_COST"}})
    assert [cfg.calls_per_example({"strategy": s}) for s in ({"type": "debate"}, {"type": "critic"}, {"type": "self-consistency", "k": 2}, {"type": "adaptive"})] == [6, 3, 2, 5]
    assert cfg.calls_per_example({"strategy": {"type": "debate"}, "budget": {"max_calls": 4}}) == 4 and cfg.check_strategy({"strategy": {"type": "debate", "agents": 5, "rounds": 2}}) == ["agents must be 2 to 4"]
    assert cfg.providers({"model": {"provider": "a"}, "strategy": {"cheap_model": {}, "models": [{"provider": "b"}]}}) == {"a", "b", "mock"}
    assert cfg.safe_name("a/b é-1_") == "a_b_é-1_" and cfg.placeholder({"type": ["null", "integer"]}) == 0 and cfg.empty_output("robustness")["abstain"]
    schema = {"required": ["n", "t"], "properties": {"n": {"type": ["null", "number"]}, "t": {"type": "string"}, "x": {"type": "object"}}}
    assert cfg.empty_output("structured_extraction", {"json_schema": schema}) == {"n": 0.0, "t": ""} and cfg.placeholder("string") is None
    assert cfg.safe({"a": 1, "thoughts": 2, "b": [{"raw_output": 1, "c": 3}]}) == {"a": 1, "b": [{"c": 3}]}
    assert cfg.diff({"a": 1, "b": [1, 2]}, {"a": True, "b": [1], "c": None}) == [("$.a", "int", "1", "bool", "true"), ("$.b[1]", "int", "2", "missing", ""), ("$.c", "missing", "", "NoneType", "null")]


def test_sources_of_replies(spark, tmp_path):
    codes = spark.createDataFrame([(c,) for c in (401, 403, 429, 400, 413, 500, 599, 600, 404, None)], "status int").select(files.status_error().alias("e")).collect()
    assert [r.e.kind for r in codes] == ["AUTH_ERROR", "AUTH_ERROR", "RATE_LIMIT", "INVALID_REQUEST", "CONTEXT_LENGTH", "PROVIDER_UNAVAILABLE", "PROVIDER_UNAVAILABLE", *["UNKNOWN_PROVIDER_ERROR"] * 3]
    assert [r.e.retryable for r in codes] == [False, False, True, False, False, True, True, False, False, False]
    urls = [None, "", "http://LOCALHOST:1/v1", "http://127.0.0.1", "http://[::1]:8/", "https://x.org"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(files.url_class()).collect()] == ["unspecified", "unspecified", "local", "local", "local", "remote"]
    bodies = ['{"choices":[{"message":{"content":"hi"},"finish_reason":"length"}],"usage":{"prompt_tokens":10,"completion_tokens":5}}', '{"choices":[{"message":{"content":"x"}}],"prompt_eval_count":7,"eval_count":2}', '{"choices":[]}']
    rows = [(b, p) for b in bodies for p in ("ollama", "other")]
    got = [r.r for r in spark.createDataFrame(rows, "body string, provider string").select(files.chat_response(rate_in=1.0, rate_out=2.0).alias("r")).collect()]
    assert [(r.output, r.input_tokens, r.usage_source, r.finish_reason, r.error) for r in got] == [
        ("hi", 10, "PROVIDER_REPORTED", "length", None), ("hi", 10, "PROVIDER_REPORTED", "length", None), ("x", 7, "PROVIDER_REPORTED", "stop", None), ("x", None, None, "stop", None),
        (None, None, None, None, "UNKNOWN_PROVIDER_ERROR"), (None, None, None, None, "UNKNOWN_PROVIDER_ERROR"),
    ]
    assert got[0].cost == 0.02 and got[3].cost == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "gold": 1}\n\nnot json\n')
    bad = files.bad_lines(spark, str(tmp_path / "x.jsonl")).collect()
    assert [(r.line, r.problem.endswith("x.jsonl:3: invalid JSON")) for r in bad] == [(3, True)]
    assert [r.id for r in files.read_ids(spark, str(tmp_path / "x.jsonl")).where("id is not null").collect()] == ["a"]
    m = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "b", None)], "example_id int, metric string, value double")
    made = files.write_run(str(tmp_path / "run"), {"z": 1, "a": 2}, m, m, report={"ok": True})
    assert set(made) == {"predictions", "metrics", "metrics_csv", "config", "report"}
    assert spark.read.csv(str(tmp_path / "run/metrics_csv"), header=True).columns == ["example_id", "a", "b"]
    files.write_progress(spark, str(tmp_path / "p.json"), {"done": 1})
    files.write_progress(spark, str(tmp_path / "p.json"), {"done": 2})
    assert (tmp_path / "p.json").read_text() == '{"done":2}'
    before = files.file_sha256(spark, str(tmp_path / "x.jsonl"))
    assert files.changed_files(before, before).isEmpty() and [r.state for r in files.changed_files(before, before.limit(0)).collect()] == ["removed"]
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table runs (id text, n integer)")
        db.executemany("insert into runs values (?, ?)", [(f"r{i}", i) for i in range(250)])
        db.execute("create table metrics (id text)")
    got = files.read_sqlite(spark, str(tmp_path / "s.db"), "runs", "id string, n long", rows_per_task=100)
    assert got.rdd.getNumPartitions() == 3 and sorted(r.n for r in got.collect()) == list(range(250))
    with pytest.raises(ValueError):
        files.read_sqlite(spark, str(tmp_path / "s.db"), "metrics", "id string")
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    merged = files.federated({"old": runs, "new": runs.withColumn("v", F.col("v") * 10)}, {"r1": "old"}, otherwise="new")
    assert sorted((r.run_id, r.v, r.source) for r in merged.collect()) == [("r1", 1, "old"), ("r2", 20, "new")]
    ex = spark.createDataFrame([(1, "a", "dev"), (2, "b", "dev"), (3, "c", "test")], "id int, payload string, split string")
    assert [r.id for r in files.disagreeing([ex, ex.where("id <> 2")], "id", "payload").collect()] == [2]
    calls = spark.createDataFrame([(1, 0, ["x", "y"], "g"), (1, 5, ["x", "y"], "g"), (2, 0, None, "critic")], "example_id int, i int, outputs array<string>, role string")
    assert [r.output for r in files.replay(calls).collect()] == ["x", "y", '{"needs_revision":false,"issues":[]}']
