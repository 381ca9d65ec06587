"""Votes, routes, ledgers and windows over calls."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ledger import admit
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import declare, register

# the winner: most votes, then mean confidence, then the earliest; its first candidate answers
declare("majority_vote", """
with g as (select user_id, day, answer, count(*) as votes, round(avg(confidence), 6) as conf, min(event_id) as first_id from {candidates}
    group by user_id, day, answer)
select user_id, day, max_by(answer, struct(votes, conf, -first_id)) as answer, max(votes) as votes, max_by(first_id, struct(votes, conf,
    -first_id)) as chosen_id, cast(sum(votes) as bigint) as n,
  round(max(votes) / sum(votes), 6) as agreement from g group by user_id, day""", """
with g as (select user_id, day, answer, count(*) as votes, round(avg(confidence), 6) as conf, min(event_id) as first_id from {candidates}
    group by user_id, day, answer),
r as (select *, row_number() over (partition by user_id, day order by votes desc, conf desc, first_id) as rn, sum(votes) over (partition by user_id, day) as n
    from g)
select user_id, day, answer, votes, first_id as chosen_id, cast(n as bigint) as n, round(votes / n, 6) as agreement from r where rn = 1""")
declare("candidate_diversity", """
select user_id, day, count(*) as n, count(distinct answer) as answers, count(distinct answer) = 1 as unanimous, round(max(confidence) - min(confidence), 4) as spread from {candidates} group by user_id, day""")
declare("vote_margin", """
with g as (select user_id, day, answer, count(*) as votes from {candidates} group by user_id, day, answer),
r as (select user_id, day, votes, row_number() over (partition by user_id, day order by votes desc, answer) as rn from g)
select user_id, day, max(case when rn = 1 then votes end) - coalesce(max(case when rn = 2 then votes end), 0) as margin from r group by user_id, day""")
declare("route_reconstruction", """
select example_id, strategy, count(*) as calls, case when count(*) = 1 then 'accept' when count(*) <= 3 then 'critic' else 'debate' end as route,
  max(case when outcome = 'PARSE_ERROR_AFTER_RESPONSE' then 1 else 0 end) as had_parse_error from {attempts} group by example_id, strategy""")
declare("router_runtime", """
with r as (select example_id, strategy, case when count(*) = 1 then 'accept' when count(*) <= 3 then 'critic' else 'debate' end as route,
  sum(latency_ms) as ms, count(*) as calls from {attempts} group by example_id, strategy)
select route, count(*) as n, cast(sum(calls) as bigint) as calls, round(avg(ms), 4) as mean_ms from r group by route""")
declare("mechanism_change_counts", """
with c as (select user_id, day, event_id, answer, lag(answer) over (partition by user_id, day order by event_id) as prev from {candidates})
select prev, answer, count(*) as n, cast(sum(case when prev <> answer then 1 else 0 end) as bigint) as changed from c where prev is not null group by prev, answer""")
declare("budget_stopped_examples", """
with r as (select example_id, attempt_id, sum(coalesce(tokens_in, 0) + coalesce(tokens_out, 0)) over (partition by example_id
    order by ts, attempt_id rows between unbounded preceding and current row) as used from {attempts})
select example_id, min(attempt_id) as stopped_at, count(*) as calls_after from r where used > 4000 group by example_id""")
declare("cumulative_cost_breach", """
select example_id, attempt_id, cast(used as bigint) as used, breach from (
  select example_id, attempt_id, used, used > 2000 and used - own <= 2000 as breach from (
    select example_id, attempt_id, coalesce(tokens_in, 0) as own, sum(coalesce(tokens_in, 0)) over (partition by example_id order by ts, attempt_id rows between unbounded preceding and current row) as used from {attempts}) x) y where breach""")
declare("sequential_interval_audit", """
with s as (select example_id, attempt_id, ts, latency_ms, lag(ts) over (partition by example_id
    order by ts, attempt_id) as prev_ts, lag(latency_ms) over (partition by example_id order by ts, attempt_id) as prev_ms from {attempts})
select example_id, count(*) as calls, cast(sum(case when unix_micros(cast(ts as timestamp)) - unix_micros(cast(prev_ts as timestamp)) < prev_ms * 1000 then 1 else 0 end) as bigint) as overlaps from s where prev_ts is not null group by example_id""", """
with s as (select example_id, attempt_id, ts, latency_ms, lag(ts) over (partition by example_id
    order by ts, attempt_id) as prev_ts, lag(latency_ms) over (partition by example_id order by ts, attempt_id) as prev_ms from {attempts})
select example_id, count(*) as calls, cast(sum(case when epoch_us(ts) - epoch_us(prev_ts) < prev_ms * 1000 then 1 else 0 end) as bigint) as overlaps from s where prev_ts is not null group by example_id""")
declare("logical_call_sessions", """
with s as (select example_id, attempt_id, ts, case when lag(ts) over (partition by example_id
    order by ts, attempt_id) >= ts - interval 30 minutes then 0 else 1 end as opens from {attempts}),
n as (select example_id, ts, attempt_id, sum(opens) over (partition by example_id
    order by ts, attempt_id rows between unbounded preceding and current row) as session from s)
select example_id, cast(session as bigint) as session, count(*) as attempts, min(ts) as started, max(ts) as ended from n group by example_id, session""")
declare("attempt_containment", """
with s as (select example_id, cast(ts as date) as day, min(ts) as started, max(ts) as ended from {attempts} where outcome = 'SUCCESS'
    group by example_id, cast(ts as date))
select s.example_id as example_id, s.day as day, count(*) as inside from {attempts} a join s on a.example_id = s.example_id and a.ts between s.started and s.ended group by s.example_id, s.day""")
declare("moving_latency", """
select example_id, attempt_id, round(avg(latency_ms) over (partition by example_id
    order by ts, attempt_id rows between 4 preceding and current row), 4) as avg5,
  rank() over (partition by example_id order by latency_ms desc) as slow_rank, ntile(4) over (partition by example_id order by ts, attempt_id) as quarter from {attempts}""")


@register("ledger_admission", """
with recursive c as (select example_id, row_number() over (partition by example_id
    order by ts, attempt_id) as k, coalesce(tokens_out, 20) as est, coalesce(tokens_in, 0) + coalesce(tokens_out, 0) as act from {attempts}),
f as (select example_id, k, case when 2000 - est > 0 then act else 0 end as used, case when 2000 - est > 0 then 1 else 0 end as admitted,
    (case when 2000 - est > 0 then act else 0 end) > 2000 as blocked from c where k = 1
  union all
  select c.example_id, c.k, f.used + case when not f.blocked and 2000 - f.used - c.est > 0 then c.act else 0 end,
    f.admitted + case when not f.blocked and 2000 - f.used - c.est > 0 then 1 else 0 end,
    f.blocked or (f.used + case when not f.blocked and 2000 - f.used - c.est > 0 then c.act else 0 end) > 2000
  from f join c on c.example_id = f.example_id and c.k = f.k + 1)
select example_id, cast(max(k) as bigint) as calls, cast(max(admitted) as bigint) as admitted, cast(max(used) as bigint) as used, bool_or(blocked) as overrun from f group by example_id""")
def ledger_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = b.attempts(spark, sf_dir).select(
        "example_id", "ts", "attempt_id", F.coalesce("tokens_out", F.lit(20)).alias("est"), (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("act"))
    return admit(calls, ["example_id"], ["ts", "attempt_id"], "est", "act", cap=2000)


@register("windowed_accounting", """
select date_trunc('day', ts) as start, event_type as kind, count(*) as attempts, round(sum(value), 4) as value from {events} group by date_trunc('day', ts), event_type""")
def windowed_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.streaming.windows import windowed_accounting as account

    return account(b.table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("latest_checkpoint_store", "select example_id, strategy, task_score, ended_at from {metrics}")
def latest_checkpoint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.operators.store import latest

    raw = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("strategy"), F.round(1 - F.col("l_discount") * 10, 2).alias("task_score"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("seq"))
    return latest(raw, ["example_id", "strategy"], "seq").select("example_id", "strategy", "task_score", F.col("seq.l_shipdate").alias("ended_at"))
