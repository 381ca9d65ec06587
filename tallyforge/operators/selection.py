"""Selections that depend on what was selected before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many of each difficulty a task gives to a pilot; fixed.
TARGETS = {"easy": 2, "medium": 2, "hard": 4}


def greedy(rows: list[tuple], targets: dict[str, int], priority: tuple[str, ...] = ()) -> list:
    """Ids of rows (difficulty, surface, reasoning, id): of each difficulty the least used surfaces first; hard ones cover ``priority`` reasonings first."""
    used: dict[str, int] = {}
    picked: list = []

    def take(pool: list[tuple]) -> bool:
        pool = [r for r in pool if r[3] not in picked]
        if pool:
            best = min(pool, key=lambda r: (used.get(r[1], 0), r[1], r[2], r[3]))
            used[best[1]] = used.get(best[1], 0) + 1
            picked.append(best[3])
        return bool(pool)

    for difficulty, limit in targets.items():
        pool, start = [r for r in rows if r[0] == difficulty], len(picked)
        for reasoning in priority if difficulty == "hard" else ():
            if len(picked) - start < limit:
                take([r for r in pool if r[2] == reasoning])
        while len(picked) - start < limit and take(pool):
            pass
    return picked


def pilot(examples: DataFrame, targets: dict[str, int] | None = None, priority: tuple[str, ...] = ()) -> DataFrame:
    """``task, place, id`` of a pilot: examples (task, difficulty, surface, reasoning, id) in the order of picking.

    A pick depends on the picks before it, so each task's candidates go through a loop.  No more than the sum of the
    targets can be picked of one difficulty, surface and reasoning, and among those the smallest ids are, so only these
    reach the loop: it does not grow with the corpus but with its families.
    """
    targets = targets or TARGETS
    most = sum(targets.values())
    place = F.row_number().over(Window.partitionBy("task", "difficulty", "surface", "reasoning").orderBy("id"))
    few = examples.select("task", "difficulty", "surface", "reasoning", "id", place.alias("place")).where(F.col("place") <= most)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = greedy(list(rows[["difficulty", "surface", "reasoning", "id"]].itertuples(index=False, name=None)), targets, priority)
        return pd.DataFrame({"task": key[0], "place": range(1, len(found) + 1), "id": found})

    kind = examples.schema["id"].dataType.simpleString()
    return few.groupBy("task").applyInPandas(run, f"task string, place int, id {kind}")


def smoke(examples: DataFrame) -> DataFrame:
    """``task, id``: of each task the first example: easy before others, then by reasoning and id; one minimum per task."""
    rank = F.struct((F.col("difficulty") != "easy").alias("rest"), "reasoning", "id")
    return examples.groupBy("task").agg(F.min(rank).alias("r")).select("task", "r.id")


def review(examples: DataFrame, most: int = 48) -> DataFrame:
    """``id, hard`` of at most ``most`` examples (id, difficulty, reasoning, surface) to be read.

    First comes one of every reasoning family, then one of every surface family (the smallest id among the hard ones,
    or among all where none is hard; families in the order of their first id), then hard ones and others by id.
    """
    hard = F.col("difficulty") == "hard"
    rank = F.struct((~hard).alias("soft"), "id")
    parts = [
        examples.groupBy(family).agg(F.min(rank).alias("r"), F.min("id").alias("first")).select("r.id", (~F.col("r.soft")).alias("hard"), F.struct(F.lit(turn).alias("turn"), F.lit(False).alias("soft"), F.col("first")).alias("place"))
        for turn, family in enumerate(("reasoning", "surface"))
    ]
    rest = examples.select("id", hard.alias("hard")).orderBy(F.desc("hard"), "id").limit(most)
    parts.append(rest.select("id", "hard", F.struct(F.lit(2).alias("turn"), (~F.col("hard")).alias("soft"), F.col("id").alias("first")).alias("place")))
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id", "hard").agg(F.min("place").alias("place"))
    return chosen.orderBy("place").limit(most).select("id", "hard")
