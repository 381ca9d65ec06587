"""A result store over the driver tables, and its lookups, accounting, reports and gates.

experiments stand on ``nation``, runs on ``supplier``, attempts and predictions on ``lineitem``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import gates
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import declare, register

_VIEWS = {
    "experiments": """
select n_nationkey as experiment_id, n_name as name, n_regionkey % 2 as dataset_hash, case when n_nationkey % 11 = 0 then 'v2' else 'v1' end as version,
    n_nationkey % 7 as config_hash, n_nationkey * 37 % 25 as created_at,
  case when n_nationkey % 9 = 0 then 'MATCHED_CALLS' else 'MATCHED_TOKENS' end as mode,
    case when n_nationkey % 4 = 0 then 4000 when n_nationkey % 4 = 1 then 8000 end as max_total_tokens,
  case when n_nationkey % 5 = 0 then 4 end as max_calls, cast(null as double) as max_cost, case when n_nationkey = 13 then 'PER_RUN' else 'PER_EXAMPLE' end as scope, n_nationkey % 3 = 0 as same_models, n_nationkey % 2 as model_group from nation""",
    "runs": """
select s_suppkey as run_id, case when s_suppkey % 97 = 96 then -1 else s_nationkey end as experiment_id,
    case s_suppkey % 5 when 0 then 'single_agent' when 1 then 'self_consistency' when 2 then 'critic_reviser' when 3 then 'multi_agent_debate'
    else 'adaptive_router' end as strategy,
  case when s_acctbal < 0 then 'FAILED' when s_acctbal < 500 then 'RUNNING' else 'COMPLETED' end as status, s_suppkey * 31 % 1000 as started_at, case when s_acctbal >= 500 then s_suppkey * 31 % 1000 + cast(floor(s_acctbal) as bigint) end as ended_at, s_suppkey % 6 as comparison from supplier""",
    "trials": """
select l_orderkey * 10 + l_linenumber as attempt_id, l_suppkey as run_id, l_orderkey as example_id, l_linenumber as seq,
    l_orderkey * 10 + cast(floor((l_linenumber + 1) / 2.0) as bigint) as logical_call_id, (l_linenumber + 1) % 2 as attempt_index,
  case l_linenumber when 1 then 'generator' when 2 then 'critic' when 3 then 'reviser' when 4 then 'agent_0' when 5 then 'agent_1' when 6 then 'repair'
    else 'judge' end as role,
  case when l_quantity < 2 then 'TIMEOUT' when l_quantity < 6 then 'PARSE_ERROR_AFTER_RESPONSE' when l_quantity > 49 then 'STARTED'
    else 'SUCCESS' end as outcome,
  case when l_quantity < 2 then 'UNKNOWN_NOT_RETURNED' when l_quantity > 45 then 'ESTIMATED' else 'PROVIDER_REPORTED' end as usage_status,
    case when l_quantity >= 2 then cast(l_quantity * 20 as bigint) end as input_tokens,
  case when l_quantity >= 2 then cast(floor(l_extendedprice / 1000) as bigint) end as output_tokens, cast(floor(l_extendedprice) as bigint) as latency_ms,
    case when l_quantity < 4 then 'length' else 'stop' end as finish_reason,
  concat(case when l_suppkey % 13 = 0 then 'p2' else 'p1' end, case when l_linenumber = 2 then '.critic-contract.v1' else '' end) as prompt_version, cast(l_tax * 10000 as bigint) as started_at, cast(l_tax * 10000 as bigint) + cast(floor(l_quantity) as bigint) as ended_at, l_returnflag as flag from lineitem""",
    "preds": """
select l_suppkey as run_id, l_orderkey as example_id, round(1 - min(l_discount) * 10, 2) as task_score, cast(sum(l_quantity * 20) as bigint) as tokens,
    cast(sum(floor(l_extendedprice)) as bigint) as latency_ms,
  cast(max(l_linenumber) as bigint) as calls, max(l_returnflag) as flag, max(l_linestatus) as status from lineitem group by l_suppkey, l_orderkey""",
}


def _view(text: str):
    name = text.rsplit(" from ", 1)[1].split()[0]
    return lambda spark, sf_dir: spark.sql(text.replace(f" from {name}", f" from {{{name}}}"), **{name: b.table(spark, sf_dir, name)})


for _name, _text in _VIEWS.items():
    b.VIEWS[_name] = _view(_text)
    b.CTES[_name] = f"{_name} as ({_text})"

# Lookups
declare("list_experiments", "select experiment_id, name, row_number() over (order by created_at desc, experiment_id) as place from {experiments}")
declare("run_experiments", "select r.run_id as run_id, r.status as status, e.experiment_id as experiment_id, e.name as name, e.config_hash as config_hash from {runs} r join {experiments} e on r.experiment_id = e.experiment_id")
declare("runs_of_experiments", "select experiment_id, run_id, strategy, status, row_number() over (partition by experiment_id order by started_at, run_id) as place from {runs}")
declare("resumable_runs", """
select e.config_hash as config_hash, max_by(r.run_id, struct(r.started_at, r.run_id)) as run_id, max(r.started_at) as started_at from {runs} r
    join {experiments} e on r.experiment_id = e.experiment_id
where r.status in ('RUNNING', 'FAILED') group by e.config_hash""", """
select config_hash, run_id, started_at from (select e.config_hash, r.run_id, r.started_at, row_number() over (partition by e.config_hash
    order by r.started_at desc, r.run_id desc) as rn from {runs} r join {experiments} e on r.experiment_id = e.experiment_id
where r.status in ('RUNNING', 'FAILED')) x where rn = 1""")
declare("run_index", "select run_id, status, strategy, row_number() over (order by started_at, run_id) as place from {runs}")
declare("example_metric_values", "select run_id, example_id, task_score as value, row_number() over (partition by run_id order by example_id) as place from {preds} where task_score is not null and status = 'F'")
declare("run_task_sets", """
select p.run_id as run_id, count(*) as n, array_sort(collect_set(d.task)) as tasks, array_sort(collect_set(d.split)) as splits,
    md5(array_join(array_sort(collect_list(cast(p.example_id as string))), ',')) as example_set
from {preds} p join {dims} d on p.example_id = d.example_id group by p.run_id""", """
select p.run_id as run_id, count(*) as n, list_sort(list_distinct(list(d.task))) as tasks, list_sort(list_distinct(list(d.split))) as splits,
    md5(array_to_string(list_sort(list(p.example_id::varchar)), ',')) as example_set
from {preds} p join {dims} d on p.example_id = d.example_id group by p.run_id""")
declare("run_aggregates", """
select run_id, metric, round(value, 6) as value from (select run_id, stack(3, 'mean_score', avg(task_score), 'mean_tokens', avg(tokens), 'n', cast(count(*) as double)) as (metric, value) from {preds} group by run_id) x""", """
with a as (select run_id, avg(task_score) as m, avg(tokens) as t, count(*)::double as n from {preds} group by run_id)
select run_id, 'mean_score' as metric, round(m, 6) as value from a union all select run_id, 'mean_tokens', round(t, 6) from a union all select run_id, 'n', n from a""")
declare("migrated_metrics", "select run_id, example_id, 'task_score' as metric_name, task_score as metric_value, case when task_score is null then 'UNSCORABLE_FAILED_OUTPUT' else 'SCORED' end as metric_status from {preds}")
declare("store_integrity", """
select 'runs' as relation, count(*) as n, count(distinct run_id) as n_keys from {runs} union all select 'experiments', count(*), count(distinct experiment_id)
    from {experiments} union all
select 'attempts', count(*), count(distinct attempt_id) from {trials} union all select 'predictions', count(*), count(distinct concat(cast(run_id as string), '/', cast(example_id as string))) from {preds}""")
declare("metric_counts", "select run_id, example_id, count(*) as n from {trials} group by run_id, example_id having count(*) > 1")
declare("example_tasks", "select p.run_id as run_id, p.example_id as example_id, d.task as task, d.split as split, d.difficulty as difficulty from {preds} p join {dims} d on p.example_id = d.example_id")
declare("example_calls", """
select run_id, example_id, logical_call_id, count(*) as attempts, max(attempt_index) as last_index, min(started_at) as started_at, max(ended_at) as ended_at,
    max_by(outcome, struct(attempt_index, outcome)) as outcome
from {trials} group by run_id, example_id, logical_call_id""", """
select run_id, example_id, logical_call_id, count(*) as attempts, max(attempt_index) as last_index, min(started_at) as started_at, max(ended_at) as ended_at,
    arg_max(outcome, row(attempt_index, outcome)) as outcome
from {trials} group by run_id, example_id, logical_call_id""")
declare("pending_failures", """
select t.run_id as run_id, t.example_id as example_id, count(*) as failed_calls, min(t.attempt_id) as first_attempt from {trials} t
    join {runs} r on t.run_id = r.run_id
where t.outcome = 'PARSE_ERROR_AFTER_RESPONSE' and r.status = 'COMPLETED' group by t.run_id, t.example_id""")
declare("checkpoint_order", """
with c as (select run_id, example_id, row_number() over (partition by run_id order by example_id) as place from {preds} where status = 'F'),
a as (select run_id, example_id, row_number() over (partition by run_id order by example_id) as place from {preds})
select a.run_id as run_id, count(*) as cohort, count(c.example_id) as done,
    count(c.example_id) = sum(case when c.place = a.place then 1 else 0 end) as is_prefix
from a left join c on a.run_id = c.run_id and a.example_id = c.example_id group by a.run_id""")

# Accounting
_ACCOUNT = """
select run_id, count(distinct logical_call_id) as logical_calls, count(*) as attempts, {ok} as successful, {bad} as failed, {unknown} as unknown,
    {rin} as reported_in, {rout} as reported_out,
  case when {unknown} = 0 and {est} = 0 then {rin} + {rout} end as exact_total, {lat} as latency_ms, {retries} as retries,
    max(case when outcome = 'STARTED' then 1 else 0 end) = 0 as latency_exact,
  case when {unknown} > 0 then 'UNKNOWN_USAGE_STOP' when {est} = 0 then 'EXACT_REPORTED' else 'ESTIMATED' end as status from {{trials}} group by run_id"""
_counts = {
    "ok": "outcome in ('SUCCESS', 'PARSE_ERROR_AFTER_RESPONSE')", "bad": "outcome not in ('SUCCESS', 'PARSE_ERROR_AFTER_RESPONSE', 'STARTED')", "unknown": "usage_status = 'UNKNOWN_NOT_RETURNED'",
    "est": "usage_status <> 'PROVIDER_REPORTED'", "retries": "attempt_index > 0",
}
_sums = {"rin": "case when usage_status = 'PROVIDER_REPORTED' then input_tokens else 0 end", "rout": "case when usage_status = 'PROVIDER_REPORTED' then output_tokens else 0 end", "lat": "latency_ms"}
declare("attempt_accounting_report", _ACCOUNT.format(**{k: f"cast(sum(case when {c} then 1 else 0 end) as bigint)" for k, c in _counts.items()}, **{k: f"cast(sum({c}) as bigint)" for k, c in _sums.items()}),
    _ACCOUNT.format(**{k: f"count(*) filter (where {c})" for k, c in _counts.items()}, **{k: f"sum({c})::bigint" for k, c in _sums.items()}))
declare("usage_against_estimate", """
select r.strategy as strategy, count(*) as calls, cast(sum(coalesce(t.input_tokens, 0) + coalesce(t.output_tokens, 0)) as bigint) as used,
    count(*) * 600 as estimated, round(cast(sum(coalesce(t.input_tokens, 0) + coalesce(t.output_tokens, 0)) as double) / (count(*) * 600), 6) as ratio,
  cast(sum(case when t.usage_status = 'PROVIDER_REPORTED' then 1 else 0 end) as bigint) as n_reported,
    cast(sum(case when t.usage_status = 'ESTIMATED' then 1 else 0 end) as bigint) as n_estimated
from {trials} t join {runs} r on t.run_id = r.run_id group by r.strategy""")
declare("strategy_result_summary", """
select * from (select r.strategy as strategy, m.metric as metric, m.value as value from {runs} r
    join (select run_id, stack(2, 'score', task_score, 'tokens', cast(tokens as double)) as (metric, value) from {preds}) m on r.run_id = m.run_id)
pivot (round(avg(value), 6) for metric in ('score' as mean_score, 'tokens' as mean_tokens))""", """
select r.strategy as strategy, round(avg(p.task_score), 6) as mean_score, round(avg(p.tokens), 6) as mean_tokens from {runs} r join {preds} p on r.run_id = p.run_id group by r.strategy""")
declare("run_accounts", """
with t as (select run_id, count(*) as attempts, count(distinct logical_call_id) as logical_calls, count(distinct example_id) as examples,
    cast(sum(coalesce(input_tokens, 0)) as bigint) as tokens_in, cast(sum(coalesce(output_tokens, 0)) as bigint) as tokens_out,
  cast(sum(latency_ms) as bigint) as latency_ms, cast(sum(case when finish_reason = 'length' then 1 else 0 end) as bigint) as length_stops from {trials}
    group by run_id),
p as (select run_id, count(*) as predictions, cast(sum(latency_ms) as bigint) as claimed_ms from {preds} group by run_id)
select r.run_id as run_id, r.status as status, t.attempts as attempts, t.logical_calls as logical_calls, t.examples as examples, t.tokens_in as tokens_in,
    t.tokens_out as tokens_out, t.latency_ms as latency_ms, t.length_stops as length_stops, p.predictions as predictions,
  t.examples = p.predictions and t.latency_ms = p.claimed_ms as reconciled from {runs} r left join t on r.run_id = t.run_id left join p on r.run_id = p.run_id""")
declare("returned_output_failures", """
select role, count(*) as n, cast(sum(case when finish_reason = 'length' then 1 else 0 end) as bigint) as length_stops,
    array_sort(collect_set(output_tokens)) as caps
from {trials} where outcome = 'PARSE_ERROR_AFTER_RESPONSE' group by role""", """
select role, count(*) as n, count(*) filter (where finish_reason = 'length') as length_stops, list_sort(list_distinct(list(output_tokens))) as caps from {trials} where outcome = 'PARSE_ERROR_AFTER_RESPONSE' group by role""")
declare("corpus_counts", """
select 'task' as axis, task as name, count(*) as n from {dims} group by task union all select 'difficulty', difficulty, count(*) from {dims}
    group by difficulty union all
select 'split', split, count(*) from {dims} group by split union all select 'scenario', scenario, count(*) from {dims} group by scenario""")
declare("trajectory_summary", """
with x as (select example_id, run_id, count(*) as calls, max(case when role = 'judge' then 1 else 0 end) as judged,
    max(case when outcome = 'TIMEOUT' then 1 else 0 end) as timed_out, sum(latency_ms) as ms from {trials} group by example_id, run_id)
select r.strategy as strategy, count(*) as trajectories, round(avg(x.calls), 6) as mean_calls, round(avg(x.ms), 4) as mean_ms, round(avg(x.judged), 6) as judged_rate, round(avg(x.timed_out), 6) as timeout_rate from x join {runs} r on x.run_id = r.run_id group by r.strategy""")
declare("budget_event_counts", """
select event, count(*) as n from (select explode(array_compact(array(case when input_tokens > 900 then 'POST_CALL_BUDGET_OVERRUN' end, case when usage_status = 'UNKNOWN_NOT_RETURNED' then 'UNKNOWN_USAGE_STOP' end, case when seq > 6 then 'PRE_CALL_BUDGET_REJECTION' end))) as event from {trials}) x group by event""", """
select 'POST_CALL_BUDGET_OVERRUN' as event, count(*) as n from {trials} where input_tokens > 900 having count(*) > 0
    union all select 'UNKNOWN_USAGE_STOP', count(*) from {trials} where usage_status = 'UNKNOWN_NOT_RETURNED' having count(*) > 0
union all select 'PRE_CALL_BUDGET_REJECTION', count(*) from {trials} where seq > 6 having count(*) > 0""")
declare("token_budget_report", """
select r.strategy as strategy, count(*) as examples, cast(sum(case when p.tokens > 1500 then 1 else 0 end) as bigint) as over, max(p.tokens) as most,
    greatest(0, max(p.tokens) - 1500) as most_over, cast(sum(case when p.tokens < 700 then 1 else 0 end) as bigint) as below_700
from {preds} p join {runs} r on p.run_id = r.run_id group by r.strategy""")
declare("runtime_extrapolation", """
with m as (select r.strategy as strategy, p.flag as cond, avg(p.latency_ms) as mean_ms, count(*) as n from {preds} p join {runs} r on p.run_id = r.run_id
    group by r.strategy, p.flag)
select strategy, round(max(mean_ms * n) * 1.2 / 3600000, 6) as hours_low, round(max(mean_ms * n) * 1.3 / 3600000, 6) as hours_high, count(*) as conditions from m group by strategy""")
declare("worst_case_cost", """
select strategy, calls, calls * 1000 as model_calls, round((calls * 1000 * 400 * cast(0.5 as double) + calls * 1000 * 256 * cast(1.5 as double)) / 1000,
    6) as cost from (
  select strategy, least(8, case strategy when 'single_agent' then 1 when 'self_consistency' then 4 when 'multi_agent_debate' then 6 when 'critic_reviser' then 3 else 5 end) as calls from {runs} group by strategy) x""")
declare("quality_ratios", """
select r.strategy as strategy, round(avg(p.task_score) / (avg(p.tokens) / 1000), 6) as of_means, round(avg(p.task_score / (p.tokens / 1000.0)), 6) as mean_of,
    round(avg(p.task_score) / (avg(p.latency_ms) / 1000), 6) as per_second,
  round(sum(p.task_score) / (sum(p.tokens) * cast(0.002 as double) / 1000), 4) as per_dollar from {preds} p join {runs} r on p.run_id = r.run_id group by r.strategy""")

# Reports, comparisons and gates
declare("observations", """
with c as (select run_id, example_id, count(*) as calls, cast(sum(case when outcome <> 'SUCCESS' then 1 else 0 end) as bigint) as failures from {trials}
    group by run_id, example_id)
select p.run_id as run_id, p.example_id as example_id, p.task_score as task_score, p.tokens as tokens, c.calls as calls, c.failures as failures,
    d.task as task, d.difficulty as difficulty, d.family as family
from {preds} p join c on p.run_id = c.run_id and p.example_id = c.example_id join {dims} d on p.example_id = d.example_id""")
declare("dominated_by", """
with g as (select r.strategy as strategy, p.flag as cond, round(avg(p.task_score), 6) as quality, round(avg(p.tokens), 6) as cost from {preds} p
    join {runs} r on p.run_id = r.run_id group by r.strategy, p.flag)
select a.cond as cond, a.strategy as strategy, a.quality as quality, a.cost as cost, array_sort(collect_list(b.strategy)) as dominated_by,
    count(b.strategy) = 0 as nondominated
from g a left join g b on a.cond = b.cond and b.quality >= a.quality and b.cost <= a.cost and (b.quality > a.quality or b.cost < a.cost) group by a.cond, a.strategy, a.quality, a.cost""", """
with g as (select r.strategy as strategy, p.flag as cond, round(avg(p.task_score), 6) as quality, round(avg(p.tokens), 6) as cost from {preds} p
    join {runs} r on p.run_id = r.run_id group by r.strategy, p.flag)
select a.cond as cond, a.strategy as strategy, a.quality as quality, a.cost as cost,
    coalesce(list_sort(list(b.strategy) filter (where b.strategy is not null)), []) as dominated_by, count(b.strategy) = 0 as nondominated
from g a left join g b on a.cond = b.cond and b.quality >= a.quality and b.cost <= a.cost and (b.quality > a.quality or b.cost < a.cost) group by a.cond, a.strategy, a.quality, a.cost""")
declare("dev_test_directions", """
with m as (select r.strategy as strategy, p.example_id % 3 = 0 as dev, avg(p.task_score) as mean from {preds} p join {runs} r on p.run_id = r.run_id
    group by r.strategy, p.example_id % 3 = 0),
b as (select dev, mean from m where strategy = 'single_agent'),
d as (select m.strategy as strategy, max(case when m.dev then m.mean - b.mean end) as dev_delta,
    max(case when not m.dev then m.mean - b.mean end) as test_delta from m join b on m.dev = b.dev group by m.strategy)
select strategy, round(dev_delta, 6) as dev_delta, round(test_delta, 6) as test_delta, case when strategy = 'single_agent' then 'reference' when dev_delta * test_delta < 0 then 'reversed' when abs(test_delta) < abs(dev_delta) then 'weakened' else 'same_direction' end as direction from d""")
# scores have two decimals: their differences are added as such, as a mean that lies half way between two results must not hang on the order of rows;
# what is no such number (not finite, or beyond 20 digits) is added as it is
_MEAN = "round(coalesce(cast(case when count({0}) = count(try_cast({0} as decimal(20, 2))) then sum(try_cast({0} as decimal(20, 2))) / {1} end as double), sum({0}) / {1}), 6) + cast(0 as double)"
_PART = "case when m.status {} 'O' then m.task_score - n.task_score else 0 end"
declare("condition_pairs", f"""
with x as (select example_id, strategy, cond, task_score, tokens, status from {{metrics}}), n as (select * from x where cond = 'A'), m as (select * from x
    where cond = 'N')
select n.strategy as strategy, m.strategy as other, count(*) as pairs, {_MEAN.format("(m.task_score - n.task_score)", "count(m.task_score - n.task_score)")} as score_delta,
    round(avg(m.tokens - n.tokens), 6) + cast(0 as double) as token_delta,
    {_MEAN.format(f"({_PART.format('=')})", "count(*)")} as from_failed,
  {_MEAN.format(f"({_PART.format('<>')})", "count(*)")} as from_valid from n join m on n.example_id = m.example_id group by n.strategy, m.strategy""", """
with x as (select example_id, strategy, cond, task_score, tokens, status from {metrics}), n as (select * from x where cond = 'A'), m as (select * from x
    where cond = 'N')
select n.strategy as strategy, m.strategy as other, count(*) as pairs, round(avg(m.task_score - n.task_score), 6) + cast(0 as double) as score_delta,
    round(avg(m.tokens - n.tokens), 6) + cast(0 as double) as token_delta,
    round(sum(case when m.status = 'O' then m.task_score - n.task_score else 0 end) / count(*), 6) + cast(0 as double) as from_failed,
  round(sum(case when m.status <> 'O' then m.task_score - n.task_score else 0 end) / count(*), 6) + cast(0 as double) as from_valid from n join m on n.example_id = m.example_id group by n.strategy, m.strategy""")
declare("changed_predictions", """
with o as (select example_id, strategy, task_score, tokens from {metrics} where strategy = 1), n as (select example_id, strategy, task_score, tokens
    from {metrics} where strategy = 2)
select coalesce(o.example_id, n.example_id) as example_id,
    case when o.example_id is null then 'added' when n.example_id is null then 'removed' when o.task_score <> n.task_score then 'changed'
    else 'same' end as state, round(n.task_score - o.task_score, 6) as delta
from o full outer join n on o.example_id = n.example_id""")
declare("artifact_discrepancies", """
with a as (select run_id, count(*) as n from {preds} group by run_id), t as (select run_id, count(distinct example_id) as n from {trials}
    where outcome <> 'STARTED' group by run_id)
select r.run_id as run_id, case when a.run_id is null then 'MISSING_PREDICTIONS' when t.run_id is null then 'MISSING_CALLS' when a.n <> t.n
    then 'COUNT_MISMATCH' when r.status <> 'COMPLETED' then 'RUN_INCOMPLETE' end as code
from {runs} r left join a on r.run_id = a.run_id left join t on r.run_id = t.run_id
where a.run_id is null or t.run_id is null or a.n <> t.n or r.status <> 'COMPLETED'""")
declare("cohort_check", """
with c as (select distinct example_id from {metrics} where strategy = 1), x as (select strategy, example_id from {metrics} where strategy <= 4)
select s.strategy as strategy, cast(sum(case when s.side = 'extra' then 1 else 0 end) as bigint) as extra,
    cast(sum(case when s.side = 'missing' then 1 else 0 end) as bigint) as missing from (
  select x.strategy as strategy, 'extra' as side from x left join c on x.example_id = c.example_id where c.example_id is null union all
  select k.strategy as strategy, 'missing' as side from (select distinct strategy from x) k join c on true left join x on x.strategy = k.strategy and x.example_id = c.example_id where x.example_id is null) s group by s.strategy""")
declare("finite_equal_audit", """
select p.run_id as run_id, count(*) as n, cast(sum(case when abs(p.claimed - p.actual) <= greatest(cast(1e-10 as double) * greatest(abs(p.claimed),
    abs(p.actual)), cast(1e-8 as double)) then 0 else 1 end) as bigint) as unequal from (
  select a.run_id as run_id, cast(a.latency_ms as double) as claimed, cast(t.ms as double) + case when a.example_id % 50 = 0 then 0.5 else 0 end as actual
    from {preds} a join (select run_id, example_id, sum(latency_ms) as ms from {trials} group by run_id, example_id) t
  on a.run_id = t.run_id and a.example_id = t.example_id) p group by p.run_id""")
declare("matrix_budget_signature", """
with f as (select comparison, experiment_id, row_number() over (partition by comparison order by run_id) as rn
    from {runs}), s as (select f.comparison as comparison, e.mode as mode, e.max_total_tokens as cap from f
    join {experiments} e on f.experiment_id = e.experiment_id where f.rn = 1)
select r.run_id as run_id, r.comparison as comparison, not (e.mode <=> s.mode and e.max_total_tokens <=> s.cap) as mismatch, count(*) over (partition by r.comparison, e.config_hash) > 1 as duplicate from {runs} r join {experiments} e on r.experiment_id = e.experiment_id join s on s.comparison = r.comparison""", """
with f as (select comparison, experiment_id, row_number() over (partition by comparison order by run_id) as rn
    from {runs}), s as (select f.comparison as comparison, e.mode as mode, e.max_total_tokens as cap from f
    join {experiments} e on f.experiment_id = e.experiment_id where f.rn = 1)
select r.run_id as run_id, r.comparison as comparison, not (e.mode is not distinct from s.mode and e.max_total_tokens is not distinct from s.cap) as mismatch, count(*) over (partition by r.comparison, e.config_hash) > 1 as duplicate from {runs} r join {experiments} e on r.experiment_id = e.experiment_id join s on s.comparison = r.comparison""")

_CODES = {
    "DATASET_HASH_MISMATCH": "e.dataset_hash", "BENCHMARK_VERSION_MISMATCH": "e.version", "BUDGET_MODE_MISMATCH": "e.mode", "TOKEN_BUDGET_MISMATCH": "e.max_total_tokens", "CALL_BUDGET_MISMATCH": "e.max_calls", "COST_BUDGET_MISMATCH": "e.max_cost",
}
_JOINED = "x as (select r.comparison as g, r.run_id, r.status, r.experiment_id, e.* exclude (experiment_id), e.experiment_id is null as missing from {runs} r left join {experiments} e on r.experiment_id = e.experiment_id)"
_EQUAL = " union all ".join(f"select g, '{code}' as code from x group by g having count(distinct coalesce({c.replace('e.', '')}::varchar, '<null>')) > 1" for code, c in _CODES.items())


@register("matched_budget_compatibility", f"""
with {_JOINED}, broken as (select g from x where missing group by g),
sets as (select p.run_id, list_sort(list(p.example_id)) as ids, list_sort(list_distinct(list(d.split))) as splits,
    list_sort(list_distinct(list(d.task))) as tasks from {{preds}} p join {{dims}} d on p.example_id = d.example_id group by p.run_id),
y as (select x.g, x.run_id, s.ids, s.splits, s.tasks from x left join sets s on s.run_id = x.run_id),
prompts as (select x.g, x.run_id, list_sort(list_distinct(list(case when t.role = 'critic' then replace(t.prompt_version, '.critic-contract.v1', '') else t.prompt_version end))) as versions from x left
    join {{trials}} t on t.run_id = x.run_id group by x.g, x.run_id),
codes as (
  select g, 'UNKNOWN_USAGE_ACCOUNTING' as code from x join {{trials}} t on t.run_id = x.run_id
    where t.usage_status = 'UNKNOWN_NOT_RETURNED' or t.input_tokens is null or t.output_tokens is null
  union all select g, 'INCOMPLETE_RUN' from x where status <> 'COMPLETED' union all select g, 'MISSING_EXPERIMENT' from broken
  union all select * from (select * from ({_EQUAL}) q union all select g, 'BUDGET_SCOPE_MISMATCH' from x where scope <> 'PER_EXAMPLE' union all
    select g, 'EXAMPLE_SET_MISMATCH' from y group by g having count(distinct coalesce(ids::varchar, '[]')) > 1 union all select g, 'SPLIT_MISMATCH' from y
    group by g having count(distinct coalesce(splits::varchar, '[]')) > 1 union all
    select g, 'TASK_FAMILY_MISMATCH' from y group by g having count(distinct coalesce(tasks::varchar, '[]')) > 1 union all select g, 'PROMPT_VERSION_MISMATCH'
    from prompts group by g having count(distinct versions::varchar) > 1 union all
    select g, 'MODEL_CONSTRAINT_MISMATCH' from x group by g having bool_or(same_models) and count(distinct model_group) > 1) z where g not in (select g
    from broken))
select k.g as comparison, n.code is null as ok, coalesce(n.code, 'OK') as code from (select distinct g from x) k left join (select distinct g, code from codes) n on n.g = k.g""")
def matched_budget_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = lambda name: b.VIEWS[name](spark, sf_dir)
    found = gates.compatibility(view("runs"), view("experiments"), view("trials"), view("preds"), view("dims"), "comparison")
    return found.select("comparison", "ok", F.explode(F.when(F.size("codes") == 0, F.array(F.lit("OK"))).otherwise(F.col("codes"))).alias("code"))
