"""Aggregates, comparisons, audits and gates of the evaluation model."""

from tallyforge.plans.registry import declare

declare("latest_metric_checkpoint", "select example_id, strategy, task_score, tokens, latency_ms, cond, status from {metrics}")
declare("duplicate_checkpoint_audit", """
select l_orderkey as example_id, l_linenumber as strategy, count(*) as n_rows, count(distinct l_partkey) as n_payloads
from {lineitem} group by l_orderkey, l_linenumber having count(*) > 1""")
declare("run_metric_means", """
select strategy, count(*) as n, round(avg(task_score), 6) as mean_score, round(avg(tokens), 6) as mean_tokens, round(avg(latency_ms), 4) as mean_latency
from {metrics} group by strategy""")
declare("run_summary_stats", """
select strategy, count(*) as n, round(avg(task_score), 6) as mean_score, round(percentile(task_score, 0.5), 6) as median_score,
  round(stddev_samp(task_score), 6) as std_score, round(percentile(tokens, 0.95), 4) as p95_tokens, min(tokens) as min_tokens, max(tokens) as max_tokens
from {metrics} group by strategy""", """
select strategy, count(*) as n, round(avg(task_score), 6) as mean_score, round(quantile_cont(task_score, 0.5), 6) as median_score,
  round(stddev_samp(task_score), 6) as std_score, round(quantile_cont(tokens, 0.95), 4) as p95_tokens, min(tokens) as min_tokens, max(tokens) as max_tokens
from {metrics} group by strategy""")
declare("paired_strategy_delta", """
select c.strategy as strategy, count(*) as common_n, round(avg(b.task_score), 6) as baseline_mean, round(avg(c.task_score), 6) as contender_mean,
  round(avg(c.task_score - b.task_score), 6) as mean_delta, sum(case when c.task_score > b.task_score then 1 else 0 end) as wins,
  sum(case when c.task_score < b.task_score then 1 else 0 end) as losses
from {metrics} b join {metrics} c on b.example_id = c.example_id where b.strategy = 1 and c.strategy <> 1 group by c.strategy""", """
select c.strategy as strategy, count(*) as common_n, round(avg(b.task_score), 6) as baseline_mean, round(avg(c.task_score), 6) as contender_mean,
  round(avg(c.task_score - b.task_score), 6) as mean_delta, cast(sum(case when c.task_score > b.task_score then 1 else 0 end) as bigint) as wins,
  cast(sum(case when c.task_score < b.task_score then 1 else 0 end) as bigint) as losses
from {metrics} b join {metrics} c on b.example_id = c.example_id where b.strategy = 1 and c.strategy <> 1 group by c.strategy""")
declare("breakdown_grouping_sets", """
select m.strategy as strategy, d.task as task, d.difficulty as difficulty, count(*) as n, round(avg(m.task_score), 6) as mean_score
from {metrics} m join {dims} d on m.example_id = d.example_id
group by grouping sets ((m.strategy, d.task), (m.strategy, d.difficulty), (m.strategy))""")
declare("condition_rollup_accounting", """
select cond, strategy, count(*) as n, cast(sum(tokens) as bigint) as total_tokens, round(avg(task_score), 6) as mean_score
from {metrics} group by rollup (cond, strategy)""")
declare("scenario_cube", """
select scenario, split, count(*) as n, count(distinct family) as families from {dims} group by cube (scenario, split)""")
declare("attempt_accounting", """
select strategy, count(*) as attempts, count(distinct example_id) as examples, cast(sum(tokens_in) as bigint) as reported_in,
    cast(sum(tokens_out) as bigint) as reported_out,
  case when count(tokens_in) = count(*) then cast(sum(tokens_in + tokens_out) as bigint) end as exact_total, count(*) - count(tokens_in) as unknown_usage,
  cast(sum(case when outcome = 'SUCCESS' then 1 else 0 end) as bigint) as successes, cast(sum(latency_ms) as bigint) as latency_ms
from {attempts} group by strategy""")
declare("usage_remaining", """
select example_id, cast(sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) as bigint) as used, greatest(0, 4000 - cast(sum(coalesce(tokens_in,
    0) + coalesce(tokens_out, 0)) as bigint)) as remaining,
  sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) > 4000 as overrun from {attempts} group by example_id""")
declare("component_coverage", """
select strategy, count(*) as expected, count(case when status = 'F' then task_score end) as available,
    count(*) - count(case when status = 'F' then task_score end) as unscorable,
  round(cast(sum(case when status = 'F' then cast(task_score as decimal(10, 2)) end) as double) / count(case when status = 'F' then task_score end),
    6) as mean_available,
  round(cast(sum(case when status = 'F' then cast(task_score as decimal(10, 2)) else 0 end) as double) / count(*), 6) as mean_with_zeros,
    cast(sum(case when status = 'O' and task_score <= 0 then 1 else 0 end) as bigint) as failed
from {metrics} group by strategy""")
declare("abstention_confusion", """
with c as (select sum(case when toxic = 1 and quality = 0 then 1 else 0 end) as tp, sum(case when toxic = 1 and quality = 1 then 1 else 0 end) as fp,
    sum(case when toxic = 0 and quality = 0 then 1 else 0 end) as fn, count(*) as n from {labels} where toxic is not null and quality is not null)
select cast(tp as bigint) as true_abstain, cast(fp as bigint) as over_abstain, cast(fn as bigint) as under_abstain,
    cast(n - tp - fp - fn as bigint) as true_answer, round(coalesce(cast(tp as double) / nullif(tp + fp, 0), 0), 6) as abstain_precision,
  round(coalesce(cast(tp as double) / nullif(tp + fn, 0), 0), 6) as abstain_recall, round(coalesce(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 0), 6) as abstain_f1, round(coalesce(cast(fp as double) / nullif(n, 0), 0), 6) as over_rate, round(coalesce(cast(fn as double) / nullif(n, 0), 0), 6) as under_rate from c""")
_LABELS = """
select example_id, strategy, 'SCHEMA_FAILURE' as label from {metrics} where status = 'O' and task_score < 0.2 union all
select example_id, strategy, 'WRONG_CITATION' as label from {metrics} where cond = 'R' and task_score < 1 union all
select example_id, strategy, 'HALLUCINATION' as label from {metrics} where cond = 'A' and task_score < 0.5 union all
select example_id, strategy, 'NUMERIC_ERROR' as label from {metrics} where task_score < 1 and tokens % 3 = 0"""
declare("failure_labels_exploded", """
select example_id, strategy, label from (select example_id, strategy, explode(array_compact(array(
  case when status = 'O' and task_score < 0.2 then 'SCHEMA_FAILURE' end, case when cond = 'R' and task_score < 1 then 'WRONG_CITATION' end,
  case when cond = 'A' and task_score < 0.5 then 'HALLUCINATION' end, case when task_score < 1 and tokens % 3 = 0 then 'NUMERIC_ERROR' end))) as label from {metrics})""", _LABELS)
declare("failure_taxonomy_counts", f"""
select strategy, label, count(*) as n, count(distinct example_id) as examples from ({_LABELS}) x group by strategy, label""")
declare("representative_cases", f"""
select label, example_id, strategy from (select label, example_id, strategy, row_number() over (partition by label order by example_id, strategy) as rn from ({_LABELS}) x) y where rn <= 3""")
declare("best_worst_examples", """
select strategy, example_id, task_score, best_rank, worst_rank from (select strategy, example_id, task_score,
  row_number() over (partition by strategy order by task_score desc, example_id) as best_rank, row_number() over (partition by strategy
    order by task_score, example_id) as worst_rank
  from {metrics}) x where best_rank <= 5 or worst_rank <= 5""", """
select strategy, example_id, task_score, best_rank, worst_rank from (select strategy, example_id, task_score,
  row_number() over (partition by strategy order by task_score desc, example_id) as best_rank, row_number() over (partition by strategy
    order by task_score, example_id) as worst_rank
  from {metrics}) x where best_rank <= 5 or worst_rank <= 5""")
_POINTS = "points as (select strategy, cond, round(avg(task_score), 6) as quality, round(avg(tokens), 6) as cost from {metrics} group by strategy, cond)"
declare("pareto_front", f"""
with {_POINTS}
select p.strategy as strategy, p.cond as cond, p.quality as quality, p.cost as cost, not exists (
  select 1 from points q where q.cond = p.cond and q.quality >= p.quality and q.cost <= p.cost and (q.quality > p.quality or q.cost < p.cost)) as nondominated from points p""", f"""
with {_POINTS}
select p.strategy as strategy, p.cond as cond, p.quality as quality, p.cost as cost, (
  select count(*) = 0 from points q where q.cond = p.cond and q.quality >= p.quality and q.cost <= p.cost and (q.quality > p.quality or q.cost < p.cost)) as nondominated from points p""")
declare("matched_budget_gate", """
select task, count(distinct difficulty) as n_signatures, count(distinct coalesce(case when split = 'P' then null else split end, 'NULL')) as n_budgets,
  case when count(distinct coalesce(case when split = 'P' then null else split end, 'NULL')) > 1 then 'BUDGET_MISMATCH' else 'OK' end as reason
from {dims} group by task""")
declare("matrix_grid", """
with s as (select distinct strategy from {metrics}), c as (select distinct cond from {metrics}), done as (select strategy, cond, count(*) as n from {metrics}
    group by strategy, cond)
select s.strategy as strategy, c.cond as cond, coalesce(d.n, 0) as n,
    case when d.n is null then 'RUN' when d.n > 2000 then 'DUPLICATE' else 'RESUME' end as plan
from s join c on true left join done d on s.strategy = d.strategy and c.cond = d.cond""")
declare("completed_run_lookup", """
select strategy, max_by(example_id, struct(ended_at, example_id)) as last_completed, max(ended_at) as ended from {metrics} where status = 'F' group by strategy""", """
select strategy, arg_max(example_id, row(ended_at, example_id)) as last_completed, max(ended_at) as ended from {metrics} where status = 'F' group by strategy""")
declare("unknown_usage_exists", """
select distinct d.example_id as example_id from {dims} d where exists (select 1 from {attempts} a where a.example_id = d.example_id and a.tokens_in is null)""")
declare("orphan_attempts", """
select a.strategy as strategy, count(*) as orphans from {attempts} a left join (select distinct example_id from {metrics}
    where status = 'F') m on a.example_id = m.example_id
where m.example_id is null group by a.strategy""")
declare("uncheckpointed_attempts", """
select a.attempt_id as attempt_id, a.example_id as example_id, a.strategy as strategy from {attempts} a
where not exists (select 1 from {metrics} m where m.example_id = a.example_id and m.strategy = a.strategy)""")
declare("checkpoint_reconciliation", """
with p as (select example_id, count(*) as strategies, cast(sum(tokens) as bigint) as claimed from {metrics} group by example_id),
a as (select example_id, count(*) as calls, cast(sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) as bigint) as recorded,
    cast(sum(case when outcome <> 'SUCCESS' then 1 else 0 end) as bigint) as failures from {attempts} group by example_id)
select p.example_id as example_id, p.strategies as strategies, coalesce(a.calls, 0) as calls, p.claimed as claimed, coalesce(a.recorded, 0) as recorded,
    coalesce(a.failures, 0) as failures,
  abs(p.claimed - coalesce(a.recorded, 0)) <= 1000 as agrees from p left join a on p.example_id = a.example_id""")
declare("carried_rows_diff", """
select example_id, strategy, task_score from {metrics} where cond <> 'N' except all select example_id, strategy, task_score from {metrics} where status = 'F'""")
declare("cohort_overlap", """
select x.strategy as a, y.strategy as b, count(*) as common from {metrics} x join {metrics} y on x.example_id = y.example_id and x.strategy < y.strategy group by x.strategy, y.strategy""")
declare("split_leakage", """
select family, count(distinct split) as splits, count(*) as n from {dims} where split in ('O', 'F') group by family having count(distinct split) > 1""")
declare("family_intersection", """
select family from {dims} where split = 'O' intersect select family from {dims} where split = 'P'""")
declare("direction_reversal", """
with b as (select example_id, cond, task_score from {metrics} where strategy = 1),
x as (select m.strategy as strategy, b.cond as cond, avg(m.task_score - b.task_score) as delta from {metrics} m join b on m.example_id = b.example_id
    where m.strategy <> 1 group by m.strategy, b.cond),
w as (select strategy, max(case when cond = 'A' then delta end) as da, max(case when cond = 'N' then delta end) as dn from x group by strategy)
select strategy, round(da, 6) as delta_a, round(dn, 6) as delta_n, da * dn < 0 as reversed from w""")
declare("condition_decomposition", """
select strategy, round(avg(case when cond = 'A' then task_score end), 6) as natural_mean, round(avg(case when cond = 'N' then task_score end),
    6) as matched_mean,
  round(avg(case when cond = 'N' then task_score end) - avg(case when cond = 'A' then task_score end), 6) as shift from {metrics} group by strategy""")
declare("token_budget_overruns", """
select strategy, count(*) as calls, cast(sum(case when tokens_in + tokens_out > 300 then 1 else 0 end) as bigint) as overruns,
    max(tokens_in + tokens_out - 300) as worst
from {attempts} where tokens_in is not null group by strategy""")
declare("quality_efficiency", """
select strategy, round(coalesce(avg(task_score) / nullif(avg(tokens), 0) * 1000, 0), 6) as per_1k_tokens,
    round(coalesce(avg(task_score) / nullif(avg(latency_ms), 0) * 1000, 0), 6) as per_second
from {metrics} group by strategy""")
declare("metric_correlation", """
select strategy, round(corr(task_score, tokens), 6) as r_tokens, round(covar_samp(task_score, latency_ms), 4) as cov_latency from {metrics} group by strategy""")
declare("metrics_unpivot", """
select strategy, metric, round(avg(value), 4) as mean_value from (
  select strategy, stack(3, 'task_score', task_score, 'tokens', cast(tokens as double), 'latency_ms', latency_ms) as (metric, value) from {metrics}) group by strategy, metric""", """
select strategy, metric, round(avg(value), 4) as mean_value from (
  select strategy, 'task_score' as metric, task_score as value from {metrics} union all select strategy, 'tokens', cast(tokens as double)
    from {metrics} union all
  select strategy, 'latency_ms', latency_ms from {metrics}) x group by strategy, metric""")
declare("score_histogram", "select strategy, cast(floor(task_score * 10) as bigint) as bin, count(*) as n from {metrics} group by strategy, cast(floor(task_score * 10) as bigint)")
