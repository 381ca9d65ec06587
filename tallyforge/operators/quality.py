"""Audits of a corpus of examples: rules per example in one Arrow pass, and rules over the collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import quality as q
from tallyforge.operators.scoring import _object

_ISSUES = T.ArrayType(T.StructType().add("rule", T.StringType()).add("issue", T.StringType()))


@F.pandas_udf(_ISSUES)
def _issues(task: pd.Series, given: pd.Series, gold: pd.Series, meta: pd.Series, rules: pd.Series) -> pd.Series:
    out = []
    for t, i, g, m, names in zip(task, given, gold, meta, rules, strict=True):
        e = q.Example(t, _object(i), _object(g), _object(m))
        out.append([{"rule": name, "issue": issue} for name in names.split(",") for issue in q.RULES[name](e)])
    return pd.Series(out)


def example_issues(examples: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """``id, rule, issue`` of examples (id, task_type, input, gold, metadata; JSON texts; what is no object counts as empty)."""
    names = F.lit(",".join(rules or q.RULES))
    found = examples.select("id", F.explode(_issues("task_type", "input", "gold", "metadata", names)).alias("i"))
    return found.select("id", "i.rule", "i.issue")


def _meta(name: str) -> F.Column:
    return F.coalesce(F.get_json_object("metadata", f"$.{name}"), F.lit("None"))


def duplicate_ids(examples: DataFrame) -> DataFrame:
    """``id, n`` of ids that repeat."""
    return examples.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def split_leaks(examples: DataFrame) -> DataFrame:
    """``template_family, splits`` of held-out template families that stand in more than one split."""
    held = examples.where(_meta("split_policy") == "heldout_template_family").select(_meta("template_family").alias("template_family"), _meta("split").alias("split"))
    return held.groupBy("template_family").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def collection_issues(examples: DataFrame, least: int = 8) -> DataFrame:
    """``surfaces, reasonings, nominal, issues``: distinct families (a missing one counts as None), templates that are named like their document type."""
    nominal = F.count_if(_meta("template_family") == _meta("document_type"))
    facts = examples.agg(F.count_distinct(_meta("surface_form_family")).alias("surfaces"), F.count_distinct(_meta("reasoning_family")).alias("reasonings"), nominal.alias("nominal"))
    rules = {"surface_diversity_low": F.col("surfaces") < least, "reasoning_diversity_low": F.col("reasonings") < least, "nominal_templates": F.col("nominal") > 0}
    return facts.withColumn("issues", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))


def witness_report(examples: DataFrame) -> DataFrame:
    """``operation, n, ids``: examples that declare an operation which their text doesn't show."""
    found = example_issues(examples, ["witness"])
    return found.groupBy(F.col("issue").alias("operation")).agg(F.count_distinct("id").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))


def family_overlaps(dev: DataFrame, test: DataFrame, field: str = "template_family") -> DataFrame:
    """``family, n_dev, n_test`` of families on both sides; pairs are not made, a family's sides are counted."""
    sides = dev.select(_meta(field).alias("family"), F.lit(1).alias("d")).unionByName(test.select(_meta(field).alias("family"), F.lit(0).alias("d")))
    counts = sides.groupBy("family").agg(F.sum("d").alias("n_dev"), F.sum(1 - F.col("d")).alias("n_test"))
    return counts.where("n_dev > 0 and n_test > 0 and family <> 'None'")
