import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as t
from tallyforge.operators import ledger, store
from tallyforge.operators.similarity import holding_pairs
from tallyforge.sources import files
from tallyforge.streaming.windows import windowed_accounting


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_normalize_text(spark):
    assert values(spark, t.normalize_text, " Ａ  b\u0085c ", None, "") == ["a b c", "none", ""]


def test_numbers_and_dates(spark):
    assert values(spark, t.normalize_number, "3万円", "1,200", "約5千円", "none") == [30000.0, 1200.0, 5000.0, None]
    assert values(spark, t.normalize_date, "令和6年4月1日", "2026/4/1", "2026-13-1", "later") == ["2024-04-01", "2026-04-01", "2026-13-1", "later"]


@pytest.mark.parametrize("a, b, want", [([], [], 1.0), (["x"], [], 0.0), (["x", "x", "y"], ["x", "z"], 0.4)])
def test_multiset_f1(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(t.multiset_f1(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_ledger_rejects_without_consuming_and_blocks_after_overrun(spark):
    calls = spark.createDataFrame([(1, i, e, a) for i, (e, a) in enumerate([(3, 4), (9, 9), (2, 3), (1, 9), (1, 1)])], "k int, i int, est int, act int")
    assert tuple(ledger.admit(calls, ["k"], ["i"], "est", "act", 10).first()) == (1, 5, 3, 16, True)


def test_store(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "k int, seq int, v string")
    assert sorted(map(tuple, store.latest(log, ["k"], "seq").collect())) == [(1, 2, None), (2, 1, "b")]
    calls = spark.createDataFrame([(1, 1, "STARTED", 0), (1, 2, "SUCCESS", 5), (1, 3, "SUCCESS", 6), (2, 1, "STARTED", 0)], "k int, seq int, outcome string, v int")
    assert sorted(map(tuple, store.finished_first(calls, ["k"], "seq", "outcome").collect())) == [(1, 2, "SUCCESS", 5), (2, 1, "STARTED", 0)]
    assert [r.k for r in store.conflicting(calls, ["k"], "outcome", ["v"]).collect()] == [1]
    assert store.bijection(log, calls, ["k"]).isEmpty()


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\nnot json\n')
    rows = {r.id: r.bad_line for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()}
    assert rows == {"a": None, None: "not json"}
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table runs (id text, n integer)")
        db.execute("insert into runs values ('r', 3)")
    assert tuple(files.read_sqlite(spark, str(tmp_path / "s.db"), "runs", "id string, n long").first()) == ("r", 3)


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_accounting(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("acc").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed, batch = {tuple(r) for r in spark.table("acc").collect()}, {tuple(r) for r in windowed_accounting(events).collect()}
    assert closed and closed <= batch


def test_holding_pairs(spark):
    docs = [(1, "xa b c d e fx y"), (2, None), (3, ""), (None, "so a b c d e f"), (4, "a b  c d e f"), (5, "short one"), (5, "ort o")]
    items = [(10, "a b c d e f"), (11, "ort o"), (12, None), (13, "b  c d e f"), (10, "a b c d e f")]
    got = holding_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, j) for i, x in docs for j, y in dict.fromkeys(items) if x is not None and y is not None and y in x]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
