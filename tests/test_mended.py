"""Answers that were wrong once, fronts, numbered lines and streams of attempts, against plain loops."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import config
from tallyforge.operators import failures, gates, selection, skyline
from tallyforge.sources import files
from tallyforge.streaming import attempts


def test_prompt_versions_by_role(spark):
    """The critic's contract is cut from critics' versions only."""
    runs = spark.createDataFrame([(1, 1, 1, "COMPLETED"), (2, 1, 1, "COMPLETED"), (3, 1, 2, "COMPLETED"), (4, 1, 2, "COMPLETED")], "run_id int, experiment_id int, comparison int, status string")
    exp = spark.createDataFrame([(1, "h", "v", "m", 1, 1, 1.0, "PER_EXAMPLE", False, "g")], "experiment_id int, dataset_hash string, version string, mode string, max_total_tokens int, max_calls int, max_cost double, scope string, same_models boolean, model_group string")
    calls = [(1, "generator", "p1"), (2, "generator", "p1.critic-contract.v1"), (3, "critic", "p1"), (4, "critic", "p1.critic-contract.v1")]
    used = spark.createDataFrame([(r, x, p, "PROVIDER_REPORTED", 1, 1) for r, x, p in calls], "run_id int, role string, prompt_version string, usage_status string, input_tokens int, output_tokens int")
    done = spark.createDataFrame([(r, e) for r in (1, 2, 3, 4) for e in ("a", "b")], "run_id int, example_id string")
    examples = spark.createDataFrame([("a", "s", "t"), ("b", "s", "t")], "example_id string, split string, task string")
    codes = lambda d: {r.comparison: r.codes for r in gates.compatibility(runs, exp, used, d, examples, "comparison").collect()}
    assert codes(done) == {1: ["PROMPT_VERSION_MISMATCH"], 2: []}
    assert codes(done.where("not (run_id = 3 and example_id = 'b')"))[2] == ["EXAMPLE_SET_MISMATCH"]


def test_truth_of_json_fields(spark):
    values = [False, True, 0, 0.0, 1, 0.5, -1, "", "0", "false", "x", [], [0], {}, {"a": 0}, None]
    rows = [(i, json.dumps({"abstain": v})) for i, v in enumerate(values)] + [(90, "{}"), (91, '{"abstain":0e3}'), (92, "no json"), (93, None)]
    df = spark.createDataFrame(rows, "i int, output string").select("i", failures._flag("output", "$.abstain", False).alias("no"), failures._flag("output", "$.abstain", True).alias("yes"))
    got = {r.i: (r.no, r.yes) for r in df.collect()}
    assert got == {i: (bool(v), bool(v)) for i, v in enumerate(values)} | {90: (False, True), 91: (False, False), 92: (False, True), 93: (False, True)}


def test_a_null_answer_is_an_answer(spark):
    gold = '{"answerable":true,"answer":"a","acceptable_answers":["a"],"evidence":["e1"]}'
    out = lambda answer, c: json.dumps({"answer": answer, "citations": [], "abstain": False, "confidence": c})
    cases = [[out(None, 0.1), out(None, 0.2)], [out("x", 0.1), out("x", 0.2)], ['{"confidence":0.1}', '{"confidence":0.2}'], [out(None, 0.1), out("x", 0.1)]]
    df = spark.createDataFrame([(i, "grounded_qa", '{"question":"q","evidence_units":[]}', gold, "{}", c) for i, c in enumerate(cases)], "i int, task_type string, input string, gold string, metadata string, candidates array<string>")
    assert {r.i: r.answers for r in failures.candidate_facts(df, ["i"]).collect()} == {0: 1, 1: 1, 2: 2, 3: 2}


def test_names_of_variables():
    env = {"A_1": "x", "lower": "y", "_B": "z"}
    assert config.resolve_env({"k": ["${A_1} ${lower} ${_B} ${NO} ${1A}"]}, env) == {"k": ["x ${lower} z ${NO} ${1A}"]}


def plain_review(rows, most=48):
    chosen = {}
    for at in (2, 3):
        families = {}
        for r in sorted(rows):
            families.setdefault(r[at], []).append(r)
        for some in families.values():
            first = min([r for r in some if r[1] == "hard"] or some)
            chosen[first[0]] = first
    for r in sorted(rows, key=lambda r: (r[1] != "hard", r[0])):
        chosen[r[0]] = r
        if len(chosen) >= most:
            break
    return [(r[0], r[1] == "hard") for r in list(chosen.values())[:most]]


@pytest.mark.parametrize("n, families, hard", [(10, 3, 0.5), (300, 6, 0.1), (300, 40, 0.02), (200, 5, 0.9)])
def test_review_sample(spark, n, families, hard):
    rng = random.Random(n + families)
    rows = [(f"e{i:04d}", "hard" if rng.random() < hard else rng.choice(["easy", "medium"]), f"r{rng.randrange(families)}", f"s{rng.randrange(families)}") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, difficulty string, reasoning string, surface string").repartition(4)
    assert [tuple(r) for r in selection.review(df).collect()] == plain_review(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_fronts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, float("nan"), rng.randint(0, 12) / 4, rng.random() * 3]), rng.choice([None, rng.randint(0, 9)])) for i in range(400)] + [("c", 900, 1.0, 1), ("c", 901, 1.0, 1), ("c", 902, 1.0, 2)]
    known = [r for r in rows if r[2] is not None and r[2] == r[2] and r[3] is not None]
    want = sorted(r[1] for r in known if not any(x[0] == r[0] and x[2] >= r[2] and x[3] <= r[3] and (x[2] > r[2] or x[3] < r[3]) for x in known))
    df = spark.createDataFrame(rows, "g string, i int, q double, c int").repartition(6)
    assert sorted(r.i for r in skyline.nondominated(df, ["g"], "q", "c").collect()) == want
    assert skyline.nondominated(df.limit(0), ["g"], "q", "c").isEmpty()


def test_lines_are_numbered_over_tasks(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "x": "y" * (i % 90)}) for i in range(3000)]
    bad = {5: "{", 1717: '{"a":', 2999: "x"}
    fine = {7: "", 8: '{"a":1,"a":2}', 9: '{"a":NaN}'}
    (tmp_path / "a.jsonl").write_text("\n".join({**dict(enumerate(lines)), **bad, **fine}.values()))
    (tmp_path / "b.jsonl").write_text("{}\n{\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 4
        got = sorted((r.path.rsplit("/")[-1], r.line, r.problem.rsplit("/")[-1]) for r in files.bad_lines(spark, str(tmp_path)).collect())
        numbers = files.numbered_lines(spark, str(tmp_path / "a.jsonl")).where("line % 500 = 11").select("line", F.get_json_object("value", "$.id").alias("id")).collect()
    finally:
        spark.conf.set(name, before)
    assert got == [("a.jsonl", i + 1, f"a.jsonl:{i + 1}: invalid JSON") for i in sorted(bad)] + [("b.jsonl", 2, "b.jsonl:2: invalid JSON")]
    assert sorted((r.line, int(r.id)) for r in numbers) == [(i, i - 1) for i in range(11, 3000, 500)]


def test_streams_of_started_and_finished_attempts(spark, tmp_path):
    """Shuffled, late and repeated rows: the stream says what the table says, once time has closed."""
    rng, start = random.Random(8), dt.datetime(2026, 1, 1)
    minute = lambda m: start + dt.timedelta(minutes=m)
    begun = [(i, minute(i // 2), i % 3) for i in range(120)]
    ended = [(i, t + dt.timedelta(minutes=rng.choice([0, 3, 9, 10, 11, 15])), rng.choice(["SUCCESS", "TIMEOUT"])) for i, t, _ in begun if rng.random() < 0.8] + [(999, minute(5), "SUCCESS")]
    schemas = {"s": "attempt_id long, started_at timestamp, strategy int", "f": "attempt_id long, ended_at timestamp, outcome string"}
    for side, rows in (("s", begun), ("f", ended)):
        due = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 14)))
        parts = [due[k : k + 25] + due[k : k + 25 : 6] for k in range(0, len(due), 25)]
        far = [(10_000 + n, minute(5000 + 1000 * n), 0 if side == "s" else "SUCCESS") for n in range(2)]
        for k, part in enumerate([*parts, far[:1], far[1:]]):
            rng.shuffle(part)
            spark.createDataFrame(part, schemas[side]).coalesce(1).write.parquet(str(tmp_path / f"{side}/{k:03d}"))
    read = {side: spark.readStream.schema(schemas[side]).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / side)) for side in "sf"}
    q = attempts.lifecycles(read["s"], read["f"], "10 minutes", "15 minutes").writeStream.format("memory").queryName("lifecycles").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    tables = (spark.createDataFrame(begun * 2, schemas["s"]), spark.createDataFrame(ended * 2, schemas["f"]))
    want = sorted(tuple(r) for r in attempts.lifecycles(*tables).collect())
    got = sorted(tuple(r) for r in spark.table("lifecycles").where("attempt_id < 9000").collect())
    assert got == want or sorted(map(str, got)) == sorted(map(str, want))
    assert len(want) == 120 and {r[-1] for r in want} == {"SUCCESS", "TIMEOUT", attempts.UNKNOWN}
