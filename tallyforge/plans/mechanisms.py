"""Mechanisms of strategies, selections and replays."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import failures, mechanisms, scoring, selection
from tallyforge.plans import bindings as b
from tallyforge.plans.examples import examples
from tallyforge.plans.registry import declare, register
from tallyforge.plans.scores import _ALL, _FACTS, _SCORED


@register("output_changes", f"""
with {_ALL}, {_SCORED}, {_FACTS}
select strategy, count(*) as n, count(*) filter (where score - first > 1e-12) as improved, count(*) filter (where score - first < -1e-12) as regressed, count(*) filter (where abs(score - first) <= 1e-12) as unchanged from facts group by strategy""")
def output_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the final output scores above, below or like the first candidate."""
    e = examples(spark, sf_dir)
    rows = scoring.task_scores(e).join(failures.candidate_facts(e, ["example_id"]), "example_id").withColumn("change", mechanisms.change("first", "task_score"))
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), *[F.count_if(F.col("change") == c).alias(c) for c in ("improved", "regressed", "unchanged")])


@register("candidate_votes", """
select o_orderkey as example_id, 3::bigint as n, case when o_orderkey % 4 = 2 then 1::bigint else 2::bigint end as answers,
    case when o_orderkey % 4 = 2 then 1::bigint else 2::bigint end as full_outputs, false as tie,
  case when o_orderkey % 4 in (0, 3) and o_orderkey % 3 = 0 then 1 else 0 end as selected from {orders}""")
def candidate_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).select("example_id", F.transform("candidates", lambda c: F.struct(c.alias("output"), F.lit(0.5).alias("confidence"))).alias("candidates"))
    return mechanisms.votes(rows, ["example_id"])


_ROUTED = """r as (select run_id, example_id, case when count(*) filter (where starts_with(role, 'agent_')) > 0 then 'debate' when count(*) filter (where role in ('generator', 'critic', 'reviser', 'repair')) > 0 then 'critic' else 'unknown' end as route, count(*) as calls from {trials} group by run_id, example_id)"""


@register("routes_by_role", f"with {_ROUTED} select run_id, example_id, route, case route when 'unknown' then 'unresolved' else 'derived' end as source from r")
def routes_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanisms.routes(b.VIEWS["trials"](spark, sf_dir), ["run_id", "example_id"])


@register("router_mechanism", f"""
with {_ROUTED} select r.route, count(*) as n, round(avg(p.task_score), 6) as mean_score, round(avg(r.calls), 6) as mean_calls,
    count(*) filter (where r.route = 'critic' and p.task_score < 1) as imperfect
from r join {{preds}} p on r.run_id = p.run_id and r.example_id = p.example_id group by r.route""")
def router_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, keys = b.VIEWS["trials"](spark, sf_dir), ["run_id", "example_id"]
    rows = mechanisms.routes(t, keys).join(t.groupBy(*keys).agg(F.count("*").alias("calls")), keys).join(b.VIEWS["preds"](spark, sf_dir).select(*keys, "task_score"), keys)
    imperfect = F.count_if((F.col("route") == "critic") & (F.col("task_score") < 1))
    return rows.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("task_score"), 6).alias("mean_score"), F.round(F.avg("calls"), 6).alias("mean_calls"), imperfect.alias("imperfect"))


_ROUNDS = "select *, (l_linenumber - 1) // 2 as round, l_returnflag as answer, case when l_quantity < 6 then 'TIMEOUT' else 'SUCCESS' end as outcome from {lineitem}"


@register("debate_rounds", f"""
with x as ({_ROUNDS}), g as (select l_orderkey, round, count(*) filter (where outcome = 'SUCCESS') as ok,
    count(distinct answer) filter (where outcome = 'SUCCESS') as answers from x group by l_orderkey, round)
select l_orderkey as example_id, count(*) as attempted, count(*) filter (where ok = 2) as completed, count(*) filter (where answers > 1) as disagreements from g group by l_orderkey""")
def debate_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = b.table(spark, sf_dir, "lineitem")
    rows = raw.select(F.col("l_orderkey").alias("example_id"), F.floor((F.col("l_linenumber") - 1) / 2).alias("round"), F.col("l_returnflag").alias("answer"), F.when(F.col("l_quantity") < 6, "TIMEOUT").otherwise("SUCCESS").alias("outcome"))
    return mechanisms.debate_rounds(rows, ["example_id"])


@register("budget_fallbacks", """
with u as (select run_id, example_id, arg_max(attempt_id, attempt_id) as output from {trials} where outcome = 'SUCCESS' and role <> 'critic'
    group by run_id, example_id), a as (select distinct run_id, example_id from {trials})
select a.run_id, a.example_id, u.output, case when u.output is null then 'empty' else 'last_output' end as source from a left join u on a.run_id = u.run_id and a.example_id = u.example_id""")
def budget_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanisms.last_output(b.VIEWS["trials"](spark, sf_dir), ["run_id", "example_id"], "attempt_id", "attempt_id")


_CATEGORIES = {
    "perfect": "task_score >= 1", "failed": "task_score <= 0", "partial": "task_score > 0 and task_score < 1", "cheap_perfect": "task_score >= 1 and tokens < 500", "costly_failure": "task_score <= 0 and tokens > 800",
    "slow": "latency_ms > 60000", "fast": "latency_ms < 2000", "returned": "cond = 'R'", "accepted": "cond = 'A'", "natural": "cond = 'N'", "open_failure": "status = 'O' and task_score <= 0", "finished_perfect": "status = 'F' and task_score >= 1",
}


@register("representatives", "with x as (" + " union all ".join(f"select '{name}' as category, cond, example_id, strategy from {{metrics}} where {rule}" for name, rule in _CATEGORIES.items()) + """)
select category, eligible, cond, example_id, strategy from (select *, count(*) over (partition by category) as eligible, row_number() over (partition by category order by cond, example_id, strategy) as rn from x) y where rn = 1""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanisms.representatives(b.metrics(spark, sf_dir), {name: F.expr(rule) for name, rule in _CATEGORIES.items()}, ["cond", "example_id", "strategy"])


@register("delta_extremes", """
with d as (select c.strategy, c.example_id, round(c.task_score - a.task_score, 6) as delta from {metrics} a join {metrics} c on a.example_id = c.example_id
    where a.strategy = 1 and c.strategy <> 1),
r as (select *, row_number() over (partition by strategy order by delta desc, example_id) as best, row_number() over (partition by strategy
    order by delta, example_id) as worst from d)
select strategy, example_id, delta, best as place, 'best' as side from r where best <= 2 union all select strategy, example_id, delta, worst, 'worst' from r where worst <= 2""")
def delta_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.metrics(spark, sf_dir)
    base = m.where("strategy = 1").select("example_id", F.col("task_score").alias("base"))
    d = m.where("strategy <> 1").join(base, "example_id").select("strategy", "example_id", F.round(F.col("task_score") - F.col("base"), 6).alias("delta"))
    return mechanisms.extremes(d, "strategy", "delta", "example_id")


_EXAMPLES = "select task, case when starts_with(difficulty, '1') or starts_with(difficulty, '2') then 'easy' when starts_with(difficulty, '3') then 'medium' else 'hard' end as difficulty, family as surface, scenario as reasoning, example_id as id from {dims}"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EXAMPLES.replace("starts_with", "startswith"), dims=b.dims(spark, sf_dir))


@register("pilot_selection")
def pilot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two easy, two medium and four hard examples of each task, picked one after the other; compared with a plain loop in the tests."""
    return selection.pilot(_examples(spark, sf_dir), priority=("ASIA", "EUROPE"))


declare("smoke_selection", f"with x as ({_EXAMPLES.replace('starts_with', 'startswith')}) select task, min_by(id, struct(difficulty <> 'easy', reasoning, id)) as id from x group by task",
    f"with x as ({_EXAMPLES}) select task, id from (select *, row_number() over (partition by task order by difficulty <> 'easy', reasoning, id) as rn from x) y where rn = 1")


@register("review_sample", f"""
with x as ({_EXAMPLES}),
r as (select id, difficulty, row_number() over (partition by reasoning order by difficulty <> 'hard', id) as rn, min(id) over (partition by reasoning) as f from x),
s as (select id, difficulty, row_number() over (partition by surface order by difficulty <> 'hard', id) as rn, min(id) over (partition by surface) as f from x),
a as (select id, difficulty, 0 as t, 0 as soft, f from r where rn = 1 union all select id, difficulty, 1, 0, f from s where rn = 1
  union all select id, difficulty, 2, case when difficulty = 'hard' then 0 else 1 end, id from x),
p as (select id, difficulty, row_number() over (partition by id order by t, soft, f) as rn, t, soft, f from a)
select id, difficulty = 'hard' as hard from p where rn = 1 order by t, soft, f limit 48""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.review(_examples(spark, sf_dir))


# Call graphs of the strategies, replayed over recorded calls
declare("self_consistency_replay", """
with s as (select l_orderkey as example_id, l_linenumber as i, l_returnflag as answer, l_tax as confidence from {lineitem} where l_linenumber <= 4),
g as (select example_id, answer, count(*) as n, round(avg(confidence), 9) as conf, min(i) as first from s group by example_id, answer)
select example_id, max_by(answer, struct(n, conf, -first, answer)) as answer, cast(sum(n) as bigint) as samples, max(n) as votes from g group by example_id""", """
with s as (select l_orderkey as example_id, l_linenumber as i, l_returnflag as answer, l_tax as confidence from {lineitem} where l_linenumber <= 4),
g as (select example_id, answer, count(*) as n, round(avg(confidence), 9) as conf, min(i) as first from s group by example_id, answer),
r as (select *, row_number() over (partition by example_id order by n desc, conf desc, first, answer desc) as rn from g)
select example_id, max(case when rn = 1 then answer end) as answer, sum(n)::bigint as samples, max(n) as votes from r group by example_id""")
declare("critic_reviser_replay", """
with c as (select run_id, example_id, max(case when role = 'generator' then attempt_id end) as first,
    max(case when role = 'critic' and flag <> 'N' then 1 else 0 end) as asks,
    max(case when role = 'generator' and outcome = 'PARSE_ERROR_AFTER_RESPONSE' then 1 else 0 end) as invalid,
  max(case when role = 'reviser' then attempt_id end) as revised,
    max(case when role = 'reviser' and outcome = 'PARSE_ERROR_AFTER_RESPONSE' then 1 else 0 end) as broken,
    max(case when role = 'repair' then attempt_id end) as repaired from {trials} group by run_id, example_id)
select run_id, example_id, asks = 1 or invalid = 1 as revises,
    case when (asks = 1 or invalid = 1) and revised is not null then case when broken = 1 and repaired is not null then repaired else revised end
    else first end as output,
  2 + case when asks = 1 or invalid = 1 then 1 + broken else 0 end as calls from c where first is not null""")
declare("debate_replay", """
with s as (select l_orderkey as example_id, cast(floor((l_linenumber - 1) / 3.0) as bigint) as round, l_linenumber as i, l_returnflag as answer,
    l_tax as confidence, l_quantity >= 6 as ok from {lineitem} where l_linenumber <= 6),
last as (select example_id, max(round) as round from s where ok group by example_id),
g as (select s.example_id as example_id, s.round as round, s.answer as answer, count(*) as n, round(avg(s.confidence), 9) as conf, min(s.i) as first from s
    join last on s.example_id = last.example_id and s.round = last.round where s.ok group by s.example_id, s.round, s.answer),
r as (select example_id, round, answer, n, row_number() over (partition by example_id order by n desc, conf desc, first, answer desc) as rn from g)
select example_id, round, answer, n as votes from r where rn = 1""")
declare("panel_replay", """
with s as (select l_orderkey as example_id, l_suppkey % 3 as model, l_linenumber as i, l_linestatus as answer, l_tax as confidence from {lineitem}),
one as (select example_id, model, min(struct(i, answer, confidence)) as c from s group by example_id, model),
g as (select example_id, c.answer as answer, count(*) as n, round(avg(c.confidence), 9) as conf, min(c.i) as first from one group by example_id, c.answer)
select example_id, max_by(answer, struct(n, conf, -first, answer)) as answer, cast(sum(n) as bigint) as models from g group by example_id having sum(n) >= 2""", """
with s as (select l_orderkey as example_id, l_suppkey % 3 as model, l_linenumber as i, l_linestatus as answer, l_tax as confidence from {lineitem}),
one as (select * from (select *, row_number() over (partition by example_id, model order by i, answer, confidence) as rn from s) x where rn = 1),
g as (select example_id, answer, count(*) as n, round(avg(confidence), 9) as conf, min(i) as first from one
    group by example_id, answer), r as (select *, row_number() over (partition by example_id order by n desc, conf desc, first, answer desc) as rn from g)
select example_id, max(case when rn = 1 then answer end) as answer, sum(n)::bigint as models from r group by example_id having sum(n) >= 2""")
declare("adaptive_replay", """
with m as (select example_id, strategy, task_score, tokens from {metrics}),
x as (select i.example_id as example_id, case when i.task_score < 0.2 then 'debate' when i.task_score < 0.6 then 'critic' else 'accept' end as route,
    i.task_score as initial, i.tokens as cheap from m i where i.strategy = 1)
select x.example_id as example_id, x.route as route, coalesce(e.task_score, x.initial) as score, x.cheap + coalesce(e.tokens, 0) as tokens,
    x.route <> 'accept' and e.example_id is null as fell_back
from x left join m e on e.example_id = x.example_id and e.strategy = case x.route when 'critic' then 2 when 'debate' then 3 end""")
declare("single_agent_replay", "select example_id, strategy as model, task_score as score, tokens, 1 as calls from {metrics} where strategy = 1")
declare("matrix_statuses", """
with c as (select distinct config_hash from {experiments}), done as (select e.config_hash as config_hash, r.strategy as strategy, count(*) as n,
    max(case when r.status = 'COMPLETED' then 1 else 0 end) as completed from {runs} r join {experiments} e on r.experiment_id = e.experiment_id
    group by e.config_hash, r.strategy),
s as (select distinct strategy from {runs}), t as (select 'small' as tier, 2 as calls, 4000 as tokens union all select 'medium', 4, 8000
    union all select 'large', 8, 16000)
select c.config_hash as config_hash, s.strategy as strategy, t.tier as tier, least(t.calls,
    case s.strategy when 'single_agent' then 1 when 'self_consistency' then 4 when 'multi_agent_debate' then 6 when 'critic_reviser' then 3
    else 5 end) as calls, t.tokens as tokens,
  case when s.strategy = 'multi_agent_debate' and t.calls < 4 then 'SKIPPED' when d.completed = 1 then 'DUPLICATE' when d.n is not null then 'RESUME' else 'RUN' end as status from c join s on true join t on true left join done d on d.config_hash = c.config_hash and d.strategy = s.strategy""")
declare("call_lifecycle", """
select logical_call_id, attempt_index, outcome, case when attempt_index = 0 then 0 else least(cast(0.05 as double) * power(2, attempt_index - 1),
    cast(0.5 as double)) end as backoff, coalesce(input_tokens, 100) as counted_input, coalesce(output_tokens, 50) as counted_output,
  case when input_tokens is null then 'ESTIMATED' else usage_status end as usage_source, outcome = 'STARTED' as unfinished from {trials}""")
declare("retry_evidence", """
select logical_call_id, run_id, count(*) as attempts, max(ended_at) - min(started_at) as lifecycle, cast(sum(ended_at - started_at) as bigint) as recorded, max(ended_at) - min(started_at) - cast(sum(ended_at - started_at) as bigint) as unaccounted from {trials} group by logical_call_id, run_id having count(*) > 1""")
declare("historical_audit", """
select r.strategy as strategy, count(*) as predictions, cast(sum(case when t.example_id is null then 1 else 0 end) as bigint) as without_roles from {preds} p
    join {runs} r on p.run_id = r.run_id
left join (select distinct run_id, example_id from {trials} where role in ('generator', 'critic', 'agent_0')) t on t.run_id = p.run_id and t.example_id = p.example_id group by r.strategy""")
declare("budget_stop_causes", """
select run_id, example_id, max(case when seq > 6 then 1 else 0 end) = 1 as rejected_before_call,
    max(case when finish_reason = 'length' then 1 else 0 end) = 1 as length_stop,
    max(case when usage_status = 'UNKNOWN_NOT_RETURNED' then 1 else 0 end) = 1 as unknown_stop,
  max(case when seq > 6 or finish_reason = 'length' or usage_status = 'UNKNOWN_NOT_RETURNED' then 1 else 0 end) = 1 as stopped from {trials} group by run_id, example_id""")
