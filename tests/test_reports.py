"""Reports and the command line."""

import pytest
from pyspark.sql import functions as F

from tallyforge import __main__ as cli
from tallyforge import reports

DIR = "/root/testdata/sf0.001"


def test_reports(spark):
    p = spark.createDataFrame([(1, i, i / 4, 10 * i, "x" if i % 2 else None) for i in range(5)], "run_id int, example_id int, task_score double, tokens int, task string")
    a = spark.createDataFrame([(1, 1, "SUCCESS", "PROVIDER_REPORTED", 3, 4, 1.0), (1, 1, "TIMEOUT", "UNKNOWN_NOT_RETURNED", None, None, 2.0)], "run_id int, logical_call_id int, outcome string, usage_status string, input_tokens int, output_tokens int, latency_ms double")
    f = spark.createDataFrame([(1, "L"), (1, "L")], "run_id int, label string")
    got = reports.run_report(p, a, f, rounds=50)
    assert got["scores"].first().mean == 0.5 and got["failures"].first().n == 2
    r = got["accounting"].first()
    assert (r.logical_calls, r.attempts, r.successful, r.known_tokens, r.exact_tokens, r.latency_ms) == (1, 2, 1, 7, None, 3.0)
    b = {(r.axis, r.name): (r.n, r.tiny) for r in reports.breakdown(p, ["task", "run_id"], "task_score", "example_id", rounds=20).collect()}
    assert b == {("task", ""): (3, True), ("task", "x"): (2, True), ("run_id", "1"): (5, False)}
    shown = reports.markdown(spark.createDataFrame([(2, "a|b"), (1, None)], "n int, t string"), most=1)
    assert shown.split("\n")[2] == "| 1 | – |" and "goes on" in shown


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "paired_strategy_delta" in capsys.readouterr().out
    assert cli.main(["run", "corpus_counts", DIR, "--out", str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count()
    assert cli.main(["generate", str(tmp_path / "corpus")]) == 0 and cli.main(["validate", str(tmp_path / "corpus")]) == 0
    bad = spark.read.json(str(tmp_path / "corpus")).limit(3).withColumn("metadata", F.lit("{}"))
    bad.write.json(str(tmp_path / "bad"))
    assert cli.main(["validate", str(tmp_path / "bad")]) == 1 and "source_required" in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"strategy": {"type": "debate"}}')
    assert cli.main(["estimate", str(tmp_path / "c.json")]) == 0 and '"calls_per_example":6' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", DIR])
