"""What strategies did: votes over candidates, changes from the first output, routes by roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 1e-12


def canonical_answer(output: Column) -> Column:
    """The key by which outputs (JSON objects) vote: answer and abstention if it has either, else the whole object with sorted keys."""
    value = F.try_parse_json(output)
    answer, abstain = F.try_variant_get(value, "$.answer", "variant"), F.try_variant_get(value, "$.abstain", "variant")
    flag = F.coalesce(~F.get_json_object(output, "$.abstain").isin("false", "0", "", "null"), F.lit(False))
    short = F.concat(F.lit('{"abstain":'), flag.cast("string"), F.lit(',"answer":'), F.coalesce(F.to_json(answer), F.lit('""')), F.lit("}"))
    return F.when(answer.isNotNull() | abstain.isNotNull(), short).otherwise(F.coalesce(F.to_json(value), output))


def votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, answers, full_outputs, tie, selected`` of each row's ``candidates`` (array of output, confidence).

    The winner has most votes, then the highest mean confidence, then the earliest candidate, whose place is
    ``selected``; a tie is a winner with at most half the votes.  Rows without candidates don't appear.  Two aggregates, the
    first combined before its shuffle.
    """
    each = rows.select(*keys, F.posexplode("candidates").alias("pos", "c"))
    each = each.select(*keys, "pos", "c.output", "c.confidence", canonical_answer(F.col("c.output")).alias("answer"), F.coalesce(F.to_json(F.try_parse_json("c.output")), F.col("c.output")).alias("whole"))
    per = each.groupBy(*keys, "answer").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("pos").alias("first"), F.collect_set("whole").alias("wholes"))
    best = F.max(F.struct("n", "mean", (-F.col("first")).alias("early")))
    found = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("answers"), F.sum(F.size("wholes")).alias("full_outputs"), best.alias("best"))
    return found.select(*keys, "n", "answers", "full_outputs", (F.col("best.n") <= F.col("n") / 2).alias("tie"), (-F.col("best.early")).alias("selected"))


def change(initial: str, final: str) -> Column:
    """improved, regressed or unchanged, within 1e-12; null without an initial score."""
    d = F.col(final) - F.col(initial)
    return F.when(d > EXACT, "improved").when(d < -EXACT, "regressed").when(d.isNotNull(), "unchanged")


def routes(attempts: DataFrame, keys: list[str], stated: str | None = None) -> DataFrame:
    """``keys, route, source`` of each trajectory: the stated route, else debate if an agent spoke, critic if a generator, critic, reviser or repair did."""
    said = F.max(stated) if stated else F.lit(None).cast("string")
    facts = attempts.groupBy(*keys).agg(F.bool_or(F.col("role").startswith("agent_")).alias("agents"), F.bool_or(F.col("role").isin("generator", "critic", "reviser", "repair")).alias("critics"), said.alias("said"))
    known = F.col("said").isin("accept", "critic", "debate")
    route = F.when(known, F.col("said")).when(F.col("agents"), "debate").when(F.col("critics"), "critic").otherwise("unknown")
    source = F.when(known, "explicit").when(F.col("agents") | F.col("critics"), "derived").otherwise("unresolved")
    return facts.select(*keys, route.alias("route"), source.alias("source"))


def debate_rounds(attempts: DataFrame, keys: list[str], agents: int = 2) -> DataFrame:
    """``keys, attempted, completed, disagreements``: rounds, those in which every agent succeeded, and those with several answers."""
    rounds = attempts.groupBy(*keys, "round").agg(F.count_if(F.col("outcome") == "SUCCESS").alias("ok"), F.count_distinct(F.when(F.col("outcome") == "SUCCESS", F.col("answer"))).alias("answers"))
    return rounds.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if(F.col("ok") == agents).alias("completed"), F.count_if(F.col("answers") > 1).alias("disagreements"))


def last_output(attempts: DataFrame, keys: list[str], order: str, output: str) -> DataFrame:
    """``keys, output, source``: what a stopped trajectory falls back to: its last successful output of any role but critic, else nothing."""
    usable = (F.col("outcome") == "SUCCESS") & (F.col("role") != "critic")
    found = attempts.groupBy(*keys).agg(F.max_by(F.when(usable, F.col(output)), F.when(usable, F.col(order))).alias("output"))
    return found.withColumn("source", F.when(F.col("output").isNull(), "empty").otherwise("last_output"))


def representatives(rows: DataFrame, categories: dict[str, Column], order: list[str]) -> DataFrame:
    """``category, eligible`` and the first row by ``order`` of each category that has any; rows may be of several.

    One aggregate with a minimum per category: no window over a category's rows.
    """
    named = F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in categories.items()]))).alias("category")
    return rows.select(named, F.struct(*order).alias("r")).groupBy("category").agg(F.count("*").alias("eligible"), F.min("r").alias("r")).select("category", "eligible", "r.*")


def extremes(rows: DataFrame, group: str, value: str, key: str, k: int = 2) -> DataFrame:
    """``group, side, place, key, value``: the k best and k worst of each group, ties by key; each group keeps 2k rows on the way."""
    from pyspark.sql import Window

    sides = []
    for side, by in (("best", F.col(value).desc()), ("worst", F.col(value).asc())):
        place = F.row_number().over(Window.partitionBy(group).orderBy(by, key))
        sides.append(rows.select(group, key, value, place.alias("place")).where(F.col("place") <= k).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])
