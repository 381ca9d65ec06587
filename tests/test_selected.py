"""Pilots against a loop of their own, a learned router against Newton's method, and what had no test."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import config
from tallyforge.operators import routing, selection
from tallyforge.sources import files


def plain_pilot(rows, targets, priority):
    taken, surfaces = [], Counter()
    for difficulty, limit in targets.items():
        wishes = list(priority) if difficulty == "hard" else []
        while limit:
            wish = wishes.pop(0) if wishes else None
            left = sorted((surfaces[s], s, r, i) for d, s, r, i in rows if d == difficulty and i not in taken and wish in (None, r))
            if left:
                taken.append(left[0][3])
                surfaces[left[0][1]] += 1
                limit -= 1
            elif wish is None:
                break
    return taken


@pytest.mark.parametrize("n, families", [(400, 5), (60, 12), (9, 3)])
def test_pilot(spark, n, families):
    rng = random.Random(n)
    rows = [(rng.choice("uv"), rng.choice(["easy", "medium", "hard"]), f"s{rng.randrange(families)}", f"r{rng.randrange(families)}", i) for i in range(n)]
    df = spark.createDataFrame(rows, "task string, difficulty string, surface string, reasoning string, id long").repartition(4)
    got = selection.pilot(df, priority=("r2", "r0", "none")).orderBy("task", "place").collect()
    for task in "uv":
        assert [r.id for r in got if r.task == task] == plain_pilot([r[1:] for r in rows if r[0] == task], {"easy": 2, "medium": 2, "hard": 4}, ("r2", "r0", "none"))


def test_router_is_the_regression_that_newton_finds(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.4, 2.0] + 2)))).astype(float)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, label double")
    model = routing.fit(df, names, "label")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.zeros(4)
    one = np.c_[z, np.ones(400)]
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])  # an inverse strength of 1 over the sum of losses
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ w))
        w -= np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) + ridge, one.T @ (p - y) + ridge @ w)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(w[:3], abs=1e-3)
    told = routing.importance(model, names)
    assert max(t["normalized_importance"] for t in told) == 1.0 and [t["feature"] for t in told] == names
    probability = 1 / (1 + np.exp(-one @ w))
    routes = {r.id: (r.probability, r.route) for r in routing.decide(model, df, 0.5).collect()}
    for i, p in enumerate(probability):
        assert routes[i][0] == pytest.approx(p, abs=1e-3)
        if min(abs(p - 0.5), abs(p - 0.75)) > 2e-3:
            assert routes[i][1] == ("accept" if p < 0.5 else "critic" if p < 0.75 else "debate")
    routing.save(model, names, str(tmp_path / "router"))
    again = routing.load(str(tmp_path / "router"), names)
    assert again.stages[-1].coefficients.toArray() == pytest.approx(model.stages[-1].coefficients.toArray())
    with pytest.raises(ValueError):
        routing.load(str(tmp_path / "router"), ["b", "a", "c"])


def test_json_lines_come_back(spark, tmp_path):
    rows = [("1", "t", "en", '{"a":1}', "é\n", None), ("2", None, "", "{}", "", "x")]
    files.write_jsonl(spark.createDataFrame(rows, files.EXAMPLE), str(tmp_path / "out"))
    back = files.read_jsonl(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[:6] for r in back.where(F.col("bad_line").isNull()).collect()) == rows and files.bad_lines(spark, str(tmp_path / "out")).isEmpty()


def test_listed_keys():
    assert config.public({"a": 1, "b": {"a": 2}, "c": None}, {"a", "c", "z"}) == {"a": 1, "c": None}
