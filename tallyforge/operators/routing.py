"""Routers: signals of an initial output, a transparent score, what escalating gains, and a learned decision."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import routing as r
from tallyforge.operators.scoring import _object


def evaluate_router(rows: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """``split, n, right, escalated`` of a model fitted on 70 % of the rows by hash of the key."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = rows.withColumn("split", F.when(F.pmod(F.xxhash64(key), F.lit(10)) >= 7, "validation").otherwise("train"))
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, regParam=0.01, standardization=False)])
    scored = model.fit(rows.where("split = 'train'")).transform(rows)
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col(label)).alias("right"), F.count_if(F.col("prediction") == 1).alias("escalated"))


_SIGNALS = T.StructType().add("features", T.MapType(T.StringType(), T.DoubleType())).add("uncertainty", T.DoubleType()).add("route", T.StringType())


@F.pandas_udf(_SIGNALS)
def _signals(task: pd.Series, given: pd.Series, gold: pd.Series, meta: pd.Series, output: pd.Series, confidence: pd.Series, model: pd.Series, disagreement: pd.Series) -> pd.DataFrame:
    rows = []
    for t, i, g, m, o, c, name, d in zip(task, given, gold, meta, output, confidence, model, disagreement, strict=True):
        f = r.features(t, _object(i), _object(g), _object(m), _object(o), float(c), name or "unknown", float(d))
        score = r.uncertainty(f)
        rows.append((f, score, r.route(score)))
    return pd.DataFrame(rows, columns=["features", "uncertainty", "route"])


def signals(df: DataFrame) -> DataFrame:
    """``df`` with ``features`` (name to value), ``uncertainty`` and ``route`` of each initial output.

    Needs the example's JSON columns, ``output``, ``confidence``, ``model`` and ``disagreement``.
    """
    r.check_names()
    found = df.withColumn("__s", _signals("task_type", "input", "gold", "metadata", "output", "confidence", "model", "disagreement"))
    return found.select(*df.columns, "__s.features", "__s.uncertainty", "__s.route")


def utility(df: DataFrame, tokens: float = 0.0, calls: float = 0.0, cost: float = 0.0, least: float = 0.0, per_tokens: float = 1000.0, per_calls: float = 1.0, per_cost: float = 1.0) -> DataFrame:
    """``df`` with ``quality_gain, extra_tokens, extra_calls, extra_cost, utility_gain, label`` of escalating.

    Needs initial_ and escalated_ ``quality, tokens, calls, cost``; the weights price what escalating takes on top.
    """
    extra = {k: F.col(f"escalated_{k}") - F.col(f"initial_{k}") for k in ("quality", "tokens", "calls", "cost")}
    gain = extra["quality"] - tokens * (extra["tokens"] / per_tokens) - calls * (extra["calls"] / per_calls) - cost * (extra["cost"] / per_cost)
    return df.select("*", extra["quality"].alias("quality_gain"), extra["tokens"].alias("extra_tokens"), extra["calls"].alias("extra_calls"), extra["cost"].alias("extra_cost"), gain.alias("utility_gain"), (gain > least).cast("int").alias("label"))


def fit(rows: DataFrame, names: list[str], label: str = "label"):
    """A pipeline of standardised features and logistic regression, fitted on ``rows`` (splits train and dev only)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    r.check_names(tuple(names))
    if "split" in rows.columns and not rows.where(~F.col("split").isin("train", "dev")).isEmpty():
        raise ValueError("a router is fitted on train or dev rows only")
    n = max(1, rows.count())
    stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True), LogisticRegression(featuresCol="x", labelCol=label, regParam=1 / n, standardization=False)]
    return Pipeline(stages=stages).fit(rows)


def decide(model, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``rows`` with ``probability`` of gain, and ``route``: accept below the threshold, critic below 0.75, else debate."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(rows).withColumn("probability", p)
    way = F.when(F.col("probability") < threshold, "accept").when(F.col("probability") < r.DEBATE_FROM, "critic").otherwise("debate")
    return scored.drop("raw", "x", "rawPrediction", "prediction").withColumn("route", way)


def importance(model, names: list[str]) -> list[dict]:
    """Each feature's coefficient, and its size against the greatest."""
    coefficients = model.stages[-1].coefficients.toArray().tolist()
    most = max(map(abs, coefficients), default=0) or 1.0
    return [{"feature": f, "coefficient": c, "normalized_importance": abs(c) / most} for f, c in zip(names, coefficients, strict=True)]


def save(model, names: list[str], path: str) -> None:
    """The pipeline and, beside it, a digest of its features' names in order."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(names, schema_digest(names))], "names array<string>, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def load(path: str, names: list[str]):
    """A saved pipeline; raises if it was fitted on other features."""
    from pyspark.ml import PipelineModel

    kept = SparkSession.getActiveSession().read.json(f"{path}/schema").first()
    if kept.digest != schema_digest(names):
        raise ValueError("the router was fitted on other features")
    return PipelineModel.load(f"{path}/model")


def schema_digest(names: list[str]) -> str:
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """``tp, fp, tn, fn``, precision, recall and F1 (0 where nothing is there) and rates of two boolean columns."""
    p, a = F.col(predicted), F.col(actual)
    counts = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"), F.count("*").alias("n"))
    over = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    precision, recall = over(F.col("tp"), F.col("tp") + F.col("fp")), over(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), over(F.col("tp") + F.col("fp"), F.col("n")).alias("rate"), over(F.col("fp"), F.col("n")).alias("needless_rate"), over(F.col("fn"), F.col("n")).alias("missed_rate"))
