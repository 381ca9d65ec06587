"""A ledger on a stream whose calls come shuffled, late and twice, against the ledger over the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.ledger import Limits
from tallyforge.operators import ledger
from tallyforge.streaming import ledgers

LIMITS = Limits(calls=9, input=2500, output=600, total=2900, latency=9000.0, cost=3.0)
SCHEMA = "user long, ts timestamp, seq long, estimate long, most_output long, input long, output long, latency double, cost double, reported boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ledgers.PROVIDER)
    yield
    spark.conf.set(name, before)


def test_shuffled_batches_decide_alike(spark, rocks, tmp_path):
    import datetime as dt

    rng, start = random.Random(6), dt.datetime(2026, 1, 1)
    calls = []
    for user in range(6):
        for k in range(25):
            unknown = rng.random() < 0.03
            t = start + dt.timedelta(minutes=rng.randint(0, 300))
            calls.append((user, t, k, rng.randint(0, 90), rng.choice([None, 0, 50, 300]) if rng.random() < 0.2 else None, None if unknown else rng.randint(1, 500), None if unknown else rng.randint(1, 120), float(rng.randint(1, 1500)), rng.random() / 2, rng.random() < 0.9))
    # a call is at most two hours behind the newest one when it comes, and every fifth comes twice
    due = sorted(calls, key=lambda c: c[1] + dt.timedelta(minutes=rng.randint(0, 115)))
    parts = [due[i : i + 30] + [c for n, c in enumerate(due[i : i + 30]) if n % 5 == 0] for i in range(0, len(due), 30)]
    end = start + dt.timedelta(days=30)
    flush = [(99, end, 0, 1, None, 1, 1, 1.0, 0.0, True)]
    for i, part in enumerate([*parts, flush]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = ledgers.replay_late(stream, "user", "ts", LIMITS, late="2 hours")
    q = found.writeStream.format("memory").queryName("late_calls").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    got = sorted((r.key, r.seq, r.rejected, r.cap, tuple(r.violations)) for r in spark.table("late_calls").collect())
    table = spark.createDataFrame(calls, SCHEMA)
    whole = ledger.replay(table, ["user"], ["ts", "seq"], LIMITS).select("user", F.posexplode("decisions").alias("i", "d"))
    order = {u: [c[2] for c in sorted((c for c in calls if c[0] == u), key=lambda c: (c[1], c[2]))] for u in range(6)}
    want = sorted((r.user, order[r.user][r.i], r.d.rejected, r.d.cap, tuple(r.d.violations)) for r in whole.collect())
    assert got == want and {x[2] for x in want} >= {None, "calls", "output"}
