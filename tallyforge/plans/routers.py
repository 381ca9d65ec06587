"""Routers over examples made from orders; the SQL computes signals from the orders' keys."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import routing
from tallyforge.plans import bindings as b
from tallyforge.plans.examples import ORDERS_CTE, examples
from tallyforge.plans.registry import declare, register


def _initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.least(F.lit(1.0), F.coalesce(F.get_json_object("output", "$.confidence").cast("double"), F.lit(0.5)))
    k = F.col("example_id")
    return examples(spark, sf_dir).withColumns({"confidence": confidence, "model": F.when(k % 2 == 0, "cheap-1").otherwise("large"), "disagreement": (k % 4 == 1).cast("double") / 2})


_SIGNALS = f"""{ORDERS_CTE}, s as (select k, case when k % 4 = 0 then 1 else 0 end as qa, case when k % 4 in (0, 3) then case k % 5 when 0 then 1 when 1 then 2 when 4 then 1 else 0 end else 0 end as cites,
    case when k % 4 not in (0, 3) then 0.5 else case k % 5 when 0 then 0.9 when 1 then case when k % 11 = 1 then 1.0 else 0.4 end when 2 then 1.0 when 3
    then 0.2 else 0.3 end end::double as conf,
    case when k % 4 in (0, 3) then case when k % 5 = 1 and k % 11 = 1 then 1 else 0 end when k % 4 = 1 then case when k % 3 = 0 then 1 else 0 end + case
    when k % 5 = 1 then 1 else 0 end + case when k % 5 = 3 then 1 else 0 end else 0 end as issues,
    case when k % 4 in (0, 3) and k % 5 = 3 then 1 else 0 end as abstain, case when k % 3 = 0 then 1 else 0 end as hard,
    case when k % 4 = 1 then 0.5 else 0 end::double as dis from o),
u as (select *, case when k % 4 in (0, 3) then least(1, cites / 2.0) else 0 end::double as cover from s),
v as (select *, least(1.0::double, case when issues > 0 then 0.35 else 0 end + 0.25 * case when qa = 1 and cites = 0 then 1 else 0 end + 0.2 * (1 - cover) + 0.3 * (1 - conf) + case when abstain = 1 and conf < 0.7 then 0.1 else 0 end + 0.15 * hard + 0.1 * least(3, issues) + 0.3 * dis) as score from u)"""


@register("uncertainty_routes", f"""
with {_SIGNALS} select k as example_id, round(score, 6) as uncertainty, case when round(score, 9) >= 0.75 then 'debate' when round(score, 9) >= 0.45 then 'critic' else 'accept' end as route from v""")
def uncertainty_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.signals(_initial(spark, sf_dir))
    edge = F.round("uncertainty", 9)  # sums on a threshold
    way = F.when(edge >= 0.75, "debate").when(edge >= 0.45, "critic").otherwise("accept")
    return found.select("example_id", F.round("uncertainty", 6).alias("uncertainty"), way.alias("route"))


@register("router_features", f"""
with {_SIGNALS} select 'citation_count' as feature, sum(cites)::double as total from v union all select 'schema_valid', count(*) filter (where issues = 0)
    from v union all select 'abstain_flag', sum(abstain) from v union all
select 'validator_failures', sum(issues) from v union all select 'difficulty_hard', sum(hard) from v
    union all select 'model_is_weak_or_cheap', count(*) filter (where k % 2 = 0) from v union all
select 'citation_coverage', round(sum(cover), 6) from v union all select 'citations_present', count(*) filter (where cites > 0) from v union all select 'task_grounded_qa', sum(qa) from v""")
def router_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.signals(_initial(spark, sf_dir)).select(F.explode("features").alias("feature", "value"))
    listed = ("citation_count", "schema_valid", "abstain_flag", "validator_failures", "difficulty_hard", "model_is_weak_or_cheap", "citation_coverage", "citations_present", "task_grounded_qa")
    return rows.where(F.col("feature").isin(*listed)).groupBy("feature").agg(F.round(F.sum("value"), 6).alias("total"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.metrics(spark, sf_dir).select("example_id", "strategy", "task_score", "tokens", "latency_ms")
    one, two = (m.where(F.col("strategy") == s).select("example_id", F.col("task_score").alias(f"{p}_quality"), F.col("tokens").alias(f"{p}_tokens"), F.lit(s).alias(f"{p}_calls"), (F.col("latency_ms") / 1e6).alias(f"{p}_cost")) for s, p in ((1, "initial"), (2, "escalated")))
    return one.join(two, "example_id")


_PAIRS = """p as (select a.example_id, a.task_score as iq, c.task_score as eq, a.tokens as it, c.tokens as et, a.latency_ms / 1e6 as ic, c.latency_ms / 1e6 as ec from {metrics} a join {metrics} c on a.example_id = c.example_id and a.strategy = 1 and c.strategy = 2)"""


@register("router_targets", f"""
with {_PAIRS} select example_id, round(eq - iq, 6) as quality_gain, et - it as extra_tokens, 1 as extra_calls,
    round((eq - iq) - 0.1 * ((et - it) / 1000.0::double) - 0.02 - 0.5 * (ec - ic), 6) as utility_gain,
  case when round((eq - iq) - 0.1 * ((et - it) / 1000.0::double) - 0.02 - 0.5 * (ec - ic), 6) > 0.05 then 1 else 0 end as label from p""")
def router_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = routing.utility(_pairs(spark, sf_dir), tokens=0.1, calls=0.02, cost=0.5, least=0.05)
    gain = F.round("utility_gain", 6)
    return u.select("example_id", F.round("quality_gain", 6).alias("quality_gain"), "extra_tokens", "extra_calls", gain.alias("utility_gain"), (gain > 0.05).cast("int").alias("label"))


@register("router_confusion", f"""
with {_PAIRS}, x as (select it > 500 as predicted, eq > iq as actual from p),
c as (select count(*) filter (where predicted and actual) as tp, count(*) filter (where predicted and not actual) as fp,
    count(*) filter (where not predicted and not actual) as tn, count(*) filter (where not predicted and actual) as fn, count(*) as n from x)
select tp, fp, tn, fn, n, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + fp) / n, 6) as rate, round(fp / n, 6) as needless_rate, round(fn / n, 6) as missed_rate from c""")
def router_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.confusion(_pairs(spark, sf_dir).select((F.col("initial_tokens") > 500).alias("p"), (F.col("escalated_quality") > F.col("initial_quality")).alias("a")), "p", "a")
    rates = ("precision", "recall", "f1", "rate", "needless_rate", "missed_rate")
    return found.select("tp", "fp", "tn", "fn", "n", *[F.round(c, 6).alias(c) for c in rates])


_POLICIES = """y as (select strategy, example_id, task_score as q, cast(tokens as double) as t from {metrics} where strategy <= 3),
w as (select 'always_' || strategy as policy, q, t from y union all select 'oracle', max(q), max_by(t, struct(q, -t)) from y group by example_id),
g as (select policy, avg(q) as q, avg(t) as t from w group by policy)"""
declare("policy_outcomes", f"""
with {_POLICIES} select g.policy as policy, round(g.q, 6) as quality, round(g.t, 6) as tokens, round(g.q / e.q, 6) as retained, round((e.t - g.t) / e.t, 6) as savings from g join g e on e.policy = 'always_3'""", f"""
with {_POLICIES.replace("max_by(t, struct(q, -t))", "arg_max(t, row(q, -t))")} select g.policy as policy, round(g.q, 6) as quality, round(g.t, 6) as tokens, round(g.q / e.q, 6) as retained, round((e.t - g.t) / e.t, 6) as savings from g join g e on e.policy = 'always_3'""")


@register("learned_routes")
def learned_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a router fitted on 70 % of the orders' first answers, by a digest of the key; coefficients depend on the solver, so there is no SQL."""
    names = ["initial_confidence", "citation_count", "citation_coverage", "validator_failures", "difficulty_hard", "abstain_flag"]
    rows = routing.signals(_initial(spark, sf_dir)).select("example_id", *[F.element_at("features", F.lit(f)).alias(f) for f in names], (F.col("route") != "accept").cast("double").alias("label"))
    rows = rows.withColumn("split", F.when(F.pmod(F.xxhash64("example_id"), F.lit(10)) >= 7, "test").otherwise("train"))
    return routing.decide(routing.fit(rows.where("split = 'train'"), names), rows).groupBy("split", "route").agg(F.count("*").alias("n"), F.count_if(F.col("label") == (F.col("route") != "accept").cast("double")).alias("right"))
