"""Scores of outputs as DataFrames: one Arrow pass over the rows, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import outputs as o

# types as objects: workers that import this module have no session to parse names with
TEXTS = T.ArrayType(T.StringType())
_SCORED = T.StructType().add("scores", T.MapType(T.StringType(), T.DoubleType())).add("issues", TEXTS).add("parsed", T.BooleanType())
_ACCEPTED = T.StructType().add("status", T.StringType()).add("issues", TEXTS)
_CRITIC = T.StructType().add("needs_revision", T.BooleanType()).add("issues", TEXTS).add("error", T.StringType())


def _rows(*columns: pd.Series) -> Iterator[tuple]:
    return zip(*columns, strict=True)


def _object(text: str | None) -> dict:
    value = o.loads(text)
    return value if isinstance(value, dict) else {}


class Parsed:
    """Objects of JSON texts; a text that follows itself, as an example's do for each of its candidates, is parsed once."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def __call__(self, text: str | None) -> dict:
        if text not in self.last:
            if len(self.last) > 16:
                self.last.clear()
            self.last[text] = _object(text)
        return self.last[text]


@F.pandas_udf(_SCORED)
def _score(task: pd.Series, given: pd.Series, gold: pd.Series, meta: pd.Series, output: pd.Series, failed: pd.Series) -> pd.DataFrame:
    rows = []
    for t, i, g, m, raw, bad in _rows(task, given, gold, meta, output, failed):
        i, g, m, value = _object(i), _object(g), _object(m), o.loads(raw)
        rows.append((o.evaluate(t, i, g, m, raw, bool(bad)), o.output_issues(t, g, value) if isinstance(value, dict) else ["output_must_be_object"], value is not ...))
    return pd.DataFrame(rows, columns=["scores", "issues", "parsed"])


def score(df: DataFrame) -> DataFrame:
    """All columns of ``df`` and ``scores`` (metric to value), ``issues`` (of the output's shape) and ``parsed`` (JSON syntax).

    Needs ``task_type, input, gold, metadata, output``, the last four JSON texts (what is no object counts as
    empty).  ``output`` that is no object scores as a failed output: parse 0 or 1 by its syntax, validity and
    task score 0, and every component null (not 0).  Where ``failed`` is a column and true, an object is scored
    but its validity is 0.
    """
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in df.columns else F.lit(False)
    found = df.withColumn("__found", _score("task_type", "input", "gold", "metadata", "output", failed))
    return found.select(*df.columns, "__found.scores", "__found.issues", "__found.parsed")


@F.pandas_udf(T.DoubleType())
def _task_score(task: pd.Series, given: pd.Series, gold: pd.Series, meta: pd.Series, output: pd.Series, failed: pd.Series) -> pd.Series:
    parsed = Parsed()
    return pd.Series([o.evaluate(t, parsed(i), parsed(g), parsed(m), raw, bool(bad))["task_score"] for t, i, g, m, raw, bad in _rows(task, given, gold, meta, output, failed)], dtype=float)


def task_scores(df: DataFrame) -> DataFrame:
    """``df`` and ``task_score`` alone, as ``score`` has it."""
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in df.columns else F.lit(False)
    return df.withColumn("task_score", _task_score("task_type", "input", "gold", "metadata", "output", failed))


def long_metrics(scored: DataFrame, *keys: str) -> DataFrame:
    """``keys, metric, value, status``: a row for each score; a null value is an unscorable failed output."""
    status = F.when(F.col("value").isNull(), "UNSCORABLE_FAILED_OUTPUT").otherwise("SCORED")
    return scored.select(*keys, F.explode("scores").alias("metric", "value")).withColumn("status", status)



@F.pandas_udf(TEXTS)
def output_issues(task: pd.Series, gold: pd.Series, output: pd.Series) -> pd.Series:
    """Issues of an output's shape for its task; ``output_must_be_object`` for what is none."""
    return pd.Series([o.output_issues(t, _object(g), x) if isinstance(x := o.loads(raw), dict) else ["output_must_be_object"] for t, g, raw in _rows(task, gold, output)])


@F.pandas_udf(_ACCEPTED)
def accept_output(task: pd.Series, gold: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """Status OK, REPAIRED or PARSE_ERROR of a provider's text, and why: an object must also be valid for its task."""
    rows = []
    for t, g, text in _rows(task, gold, raw):
        status, value = o.parse_output(text)
        found = ["malformed JSON"] if value is None else o.output_issues(t, _object(g), value)
        rows.append(("PARSE_ERROR" if found else status, found))
    return pd.DataFrame(rows, columns=["status", "issues"])


@F.pandas_udf(_CRITIC)
def read_critic(raw: pd.Series) -> pd.DataFrame:
    """A critic's reply: needs_revision and issues, or the error that makes it unusable."""
    return pd.DataFrame([o.parse_critic(x) for x in raw], columns=["needs_revision", "issues", "error"], dtype=object)


@F.pandas_udf(TEXTS)
def schema_issues(value: pd.Series, schema: pd.Series, prefix: pd.Series) -> pd.Series:
    """Issues of an object against a JSON Schema, both JSON texts."""
    return pd.Series([o.schema_issues(_object(x), _object(s), p) for x, s, p in _rows(value, schema, prefix)])
