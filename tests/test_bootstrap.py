"""Bootstrap intervals against Python's own generator, and the Poisson form against a plain loop."""

import random
import statistics

import numpy as np
import pytest

from tallyforge.functions import twister
from tallyforge.operators import bootstrap as bs


def test_ranks():
    assert bs.ranks(1000) == (24, 975) and bs.ranks(100) == (2, 97) and bs.ranks(1) == (0, 0) and bs.ranks(1000, 0.9) == (49, 950)


@pytest.mark.parametrize("seed", [0, 7, 20261003, 2**40 + 5])
@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 200])
def test_draws_are_those_of_the_standard_library(n, seed):
    rng = random.Random(seed)
    assert np.concatenate(list(bs.draws(n, 500, seed))).tolist() == [rng.randrange(n) for _ in range(500)]


def plain(values, rounds, seed):
    if not values:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    mean = sum(values) / len(values)
    low = high = mean
    if len(values) > 1 and rounds > 0:
        rng = random.Random(seed)
        means = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(rounds))
        low, high = means[bs.ranks(rounds)[0]], means[bs.ranks(rounds)[1]]
    return (len(values), mean, statistics.median(values), statistics.stdev(values) if len(values) > 1 else 0.0, low, high)


def test_exact_summary(spark):
    rng = random.Random(1)
    groups = {"a": [rng.random() for _ in range(37)], "b": [0.5], "c": [1.0, 0.0]}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)] + [("c", 9, None)]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(3)
    got = {r.g: tuple(r)[1:] for r in bs.exact_summary(df, "g", "i", "x", rounds=200, seed=3).collect()}
    assert {g: pytest.approx(plain(xs, 200, 3)) for g, xs in groups.items()} == got
    assert bs.summary(np.zeros(0), 10, 0.95, 0) == plain([], 10, 0) and bs.summary(np.array([2.0, 4.0]), 0, 0.95, 0)[4:] == (3.0, 3.0)


def test_poisson_summary_is_a_plain_fold_and_agrees_with_the_exact_one(spark):
    rng = random.Random(2)
    xs = [rng.gauss(1, 2) for _ in range(2000)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [(None, 1, 4.0)], "g string, i int, x double").repartition(5)
    got = {r.g: r for r in bs.poisson_summary(df, "g", "i", "x", rounds=300, seed=4).collect()}
    keys = np.array([r[0] for r in df.where("g = 'a'").selectExpr("xxhash64(i)", "i").orderBy("i").collect()], np.int64).view(np.uint64)
    means = sorted(sum(m * x for m, x in zip(bs._multiplicities(keys, b, 4).tolist(), xs, strict=True)) / int(bs._multiplicities(keys, b, 4).sum()) for b in range(300))
    low, high = bs.ranks(300)
    assert (got["a"].n, got["a"].mean, got["a"].low, got["a"].high) == pytest.approx((2000, sum(xs) / 2000, means[low], means[high])) and got[None].mean == 4.0
    exact = plain(xs, 300, 4)
    assert abs(got["a"].low - exact[4]) < 0.02 and abs(got["a"].high - exact[5]) < 0.02


def test_the_generator_at_any_place():
    for seed in (0, 7, 2**40 + 5):
        r = random.Random(seed)
        words = [r.getrandbits(32) for _ in range(60_000)]
        for at in (0, 1, 623, 624, 625, 5000, 59_000):
            assert twister.generator(twister.jumped(twister.seeded(seed), at)).random_raw(1000).tolist() == words[at : at + 1000]
    far = twister.jumped(twister.jumped(twister.seeded(3), 10**12 - 999), 999)
    assert twister.generator(far).random_raw(5).tolist() == twister.generator(twister.jumped(twister.seeded(3), 10**12)).random_raw(5).tolist()


def test_many_tasks_replay_one_generator(spark, monkeypatch):
    """100,000 values in eight stretches and more, small groups, one value, nulls; as Python's own generator has it."""
    rng = random.Random(9)
    groups = {"big": [rng.gauss(1, 2) for _ in range(100_000)], "small": [rng.random() for _ in range(500)], "two": [1.0, 5.0], "one": [3.0], None: [rng.random() for _ in range(64)]}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)] + [("two", 9, None), ("none", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(5)
    want = {g: (len(xs), pytest.approx(sum(xs) / len(xs)), *(pytest.approx(x, rel=1e-12) for x in plain(xs, 15, 3)[4:])) for g, xs in groups.items()}
    got = bs.stretched_interval(df, "g", "i", "x", rounds=15, seed=3, length=1 << 17, block=1 << 15)
    assert {r.g: tuple(r)[1:] for r in got.collect()} == want
    assert bs._stretches(100_000, 15, 1 << 17) >= 8
    monkeypatch.setattr(bs, "STRETCH", 1 << 19)
    mixed = bs.interval(df, "g", "i", "x", rounds=15, seed=3, alone=1000)
    assert {r.g: tuple(r)[1:] for r in mixed.collect()} == want
    assert bs.stretched_interval(df.limit(0), "g", "i", "x", rounds=15).isEmpty()
    assert {r.g: (r.low, r.high) for r in bs.stretched_interval(df.where("g = 'two'"), "g", "i", "x", rounds=0).collect()} == {"two": (3.0, 3.0)}


def test_paired(spark):
    df = spark.createDataFrame([("s", 1, 0.0, 1.0), ("s", 2, 0.5, 0.5), ("s", 3, None, 1.0)], "g string, e int, a double, b double")
    r = bs.paired(df, "g", "e", "a", "b", rounds=100).first()
    assert (r.common_n, r.baseline_mean, r.contender_mean, r.mean_difference) == (2, 0.25, 0.75, 0.5)
    assert (r.low, r.high) == plain([1.0, 0.0], 100, 0)[4:]
