"""What the findings of the third round asked for."""

import __spark_entry__ as entry


def test_condition_pairs_adds_scores_exactly(spark, tmp_path):
    """A mean half way between two results rounds up: 0.1 over 64 pairs, where 0.7 - 0.6 is less than 0.1 as a double."""
    rows = [(k, 1, 1, n, 1.0, 1.0, (0.03 if n == 2 else 0.04) if k == 0 else 0.05, "NA"[n == 1], "O", None) for k in range(64) for n in (1, 2)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in entry.queries()["condition_pairs"](spark, str(tmp_path)).collect()] == [(1, 2, 64, 0.001563, 0.0, 0.001563, 0.0)]
    odd = [*rows, (64, 1, 1, 1, 1.0, 1.0, float("nan"), "A", "O", None), (64, 1, 1, 2, 1.0, 1.0, 0.05, "N", "O", None)]
    spark.createDataFrame(odd, names).write.parquet(f"{tmp_path}/odd/lineitem.parquet")
    (row,) = entry.queries()["condition_pairs"](spark, f"{tmp_path}/odd").collect()
    assert row["pairs"] == 65 and row["score_delta"] != row["score_delta"]


def test_near_classes_name_copies_and_meet_over_chunks(spark, monkeypatch):
    """Copies stay one class and are compared once, and chunks and cells of any size find what all pairs have."""
    import difflib
    import random

    from tallyforge.operators import similarity

    monkeypatch.setattr(similarity, "CHUNK", 7)
    monkeypatch.setattr(similarity, "CELL", 3)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij ", k=rng.randint(60, 70))) for _ in range(30)]
    texts += [x[:k] + "Z" + x[k + 1 :] for x in texts[:12] for k in (5, 40)] + texts[:3] * 40 + ["", "", ""]
    rows = [(i, x, "b" if i % 5 else None, i * 7 % 2) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, block string, side int")
    alike = {(a[0], b[0]): r for a in rows for b in rows if a[3] < b[3] and a[2] == b[2] and (r := round(difflib.SequenceMatcher(None, a[1], b[1]).ratio(), 4)) >= 0.95}
    members, pairs = similarity.near_classes(df, 0.95, "block", "side")
    of = {r.id: r.class_id for r in members.collect()}
    first = {}
    for i, *key in rows:
        first.setdefault(tuple(key), i)
    assert of == {i: first[tuple(key)] for i, *key in rows}
    got = [(r.id_a, r.id_b, r.ratio) for r in pairs.collect()]
    assert sorted(got) == sorted({(of[a], of[b], r) for (a, b), r in alike.items()}) and len(got) < len(alike) / 10
    assert {(r.id_a, r.id_b): r.ratio for r in similarity.near_pairs(df, 0.95, "block", "side").collect()} == alike
    every = {(a[0], b[0]): r for a in rows for b in rows if a[0] < b[0] and (r := round(difflib.SequenceMatcher(None, a[1], b[1]).ratio(), 4)) >= 0.95}
    assert {(r.id_a, r.id_b): r.ratio for r in similarity.near_pairs(df, 0.95).collect()} == every


def test_failures_score_candidates_without_a_shuffle(spark):
    """Labels need no second reading of the examples and no exchange by key."""
    import contextlib
    import io

    from tallyforge.operators import failures

    qa = '{"answer":"%s","citations":["e1"],"abstain":false,"confidence":0.5}'
    gold = '{"answerable":true,"answer":"a","acceptable_answers":["a"],"evidence":["e1"]}'
    given = '{"question":"?","evidence_units":[{"id":"e1","text":"a"}]}'
    rows = [(k, "grounded_qa", given, gold, '{"tags":[]}', qa % "b", "multi_agent_debate", c, "{}") for k, c in enumerate(([qa % "b", qa % "a"], [qa % "b", None], [], None))]
    names = "k int, task_type string, input string, gold string, metadata string, output string, strategy string, candidates array<string>, result_metadata string"
    found = failures.annotate(spark.createDataFrame(rows, names), ["k"])
    labels = {(r.k, r.label) for r in found.collect()}
    assert {x for x in labels if x[1] in ("MAJORITY_WRONG", "PEER_ERROR_PROPAGATION")} == {(0, "MAJORITY_WRONG"), (1, "PEER_ERROR_PROPAGATION")}
    assert {k for k, x in labels if x == "HALLUCINATION"} == {0, 1, 2, 3}
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain()
    assert "Exchange" not in plan.getvalue()


def test_large_groups_hold_bounded_values(spark, monkeypatch):
    """Runs of stretches over parts of the values, of few and of many distinct ones, are one task's replay; sums of zero count as well."""
    import random

    import pytest

    from tallyforge.operators import bootstrap

    monkeypatch.setattr(bootstrap, "HELD", 256)
    rng = random.Random(2)
    rows = [(g, i, x) for i in range(400) for g, x in (("few", rng.randrange(3) / 2), ("many", rng.random()), ("zero", 0.0))]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    want = {r.g: (r.n, r.low, r.high) for r in bootstrap.exact_summary(df, "g", "i", "x", 50).collect()}
    got = {r.g: (r.n, r.low, r.high) for r in bootstrap.stretched_interval(df, "g", "i", "x", 50, length=5000, block=64).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_intervals_gather_no_rows_of_a_group(spark, monkeypatch):
    """Values are packed as they pass in their order, in bounded pieces, and rows are read once for means and ends."""
    import random

    import pytest

    from tallyforge.operators import bootstrap

    plans, table = {}, bootstrap.Scratch.table

    def seen(self, df, name):
        plans[name] = (df._jdf.queryExecution().toString(), out := table(self, df, name))
        return out

    monkeypatch.setattr(bootstrap.Scratch, "table", seen)
    rng = random.Random(3)
    rows = [("many", i, rng.random(), rng.random()) for i in range(40_000)] + [("few", i, 0.5, rng.randrange(3) / 2) for i in range(20_000)] + [("small", i, 1.0, i % 2 / 1) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, a double, b double").repartition(3)
    monkeypatch.setattr(bootstrap, "ALONE", 1000)
    got = {r.g: tuple(r)[1:] for r in bootstrap.paired(df, "g", "i", "a", "b", rounds=20, seed=5).collect()}
    sums = {g: [sum(r[k] for r in rows if r[0] == g) / sum(r[0] == g for r in rows) for k in (2, 3)] for g in ("many", "few", "small")}
    want = {r.g: (r.n, *sums[r.g], r.mean, r.low, r.high) for r in bootstrap.exact_summary(df.selectExpr("g", "i", "b - a as d"), "g", "i", "d", 20, seed=5).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert not [name for name, (plan, _) in plans.items() if "FlatMapGroupsIn" in plan]
    pieces = [out for _, out in plans.values() if "packed" in out.columns]
    assert len(pieces) == 1 and pieces[0].selectExpr("max(length(packed))").first()[0] <= 8 << 14


def test_pieces_of_few_values_may_have_many_together(spark, monkeypatch):
    """Keys that are null, NaN or structs, and groups whose pieces have few kinds each but more than a byte tells apart in all."""
    import pytest

    from tallyforge.operators import bootstrap

    monkeypatch.setattr(bootstrap, "HELD", 512)
    rows = [(g, i, float(i * 7919 % 600)) for g in (None, float("nan"), 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "g double, i int, x double")
    want = bootstrap.exact_summary(df.where("g = 1"), "g", "i", "x", 30).first()
    for key in ("g", "struct(g, 'a' as k)"):
        for found in (bootstrap.stretched_interval(df.selectExpr(f"{key} as h", "i", "x"), "h", "i", "x", 30, length=5000, block=64), bootstrap.interval(df.selectExpr(f"{key} as h", "i", "x"), "h", "i", "x", 30)):
            found = found.collect()
            assert len(found) == 3 and all((r.n, r.low, r.high) == pytest.approx((600, want.low, want.high)) for r in found)


def test_small_groups_are_dealt_over_tasks(spark):
    """However few bytes the packed values have."""
    from pyspark.sql import functions as F

    from tallyforge.operators import bootstrap

    df = spark.range(600).select((F.col("id") % 30).alias("g"), "id", F.lit(0.5).alias("x"))
    pieces = bootstrap._pieces(df, "g", "id", "x", 64)
    assert bootstrap._alone(pieces, 5, 0.95, 1).select(F.spark_partition_id().alias("p")).distinct().count() > 4
