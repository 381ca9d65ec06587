"""Ledgers over the attempts under every ceiling, with the recursion written out in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.ledger import Limits
from tallyforge.operators import ledger
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import register

#: Ceilings of a lane; each of them binds somewhere.
LIMITS = Limits(calls=9, input=2500, output=600, total=2900, latency=9000.0, cost=3.0)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by user and lane: estimates, caps, usage (null where the provider timed out), latency and cost."""
    a = b.attempts(spark, sf_dir).withColumn("lane", F.col("attempt_id") % 4)
    return a.select(
        "example_id", "lane", "ts", "attempt_id", (F.col("attempt_id") % 90).cast("long").alias("estimate"), F.when(F.col("attempt_id") % 3 > 0, (F.col("attempt_id") % 7) * 50).cast("long").alias("most_output"),
        F.col("tokens_in").alias("input"), F.col("tokens_out").alias("output"), F.col("latency_ms").cast("double").alias("latency"), (F.coalesce("tokens_in", F.lit(0)) / 1000).cast("double").alias("cost"),
        (F.col("outcome") != "PARSE_ERROR_AFTER_RESPONSE").alias("reported"),
    )


_FOLD = """
with recursive c as (
  select example_id, attempt_id % 4 as lane, row_number() over (partition by example_id, attempt_id % 4 order by ts, attempt_id) as k, attempt_id % 90 as est,
    case when attempt_id % 3 > 0 then (attempt_id % 7) * 50 end as most, tokens_in as tin, tokens_out as tout, latency_ms::double as ms, coalesce(tokens_in,
    0)::double / 1000 as cost, outcome <> 'PARSE_ERROR_AFTER_RESPONSE' as rep from {attempts}),
f as (
  select example_id, lane, 0::bigint as k, 0::bigint as n, 0::bigint as ui, 0::bigint as uo, 0.0::double as ul, 0.0::double as uc, false as unk, true as exact,
    false as over, 0::bigint as rej, ''::varchar as why from (select distinct example_id, lane from c) d
  union all
  select example_id, lane, k, n + go, ui + go * coalesce(tin, 0), uo + go * coalesce(tout, 0), ul + go * ms, uc + go * cost, unk or (go = 1 and tin is null),
    exact and (go = 0 or (rep and tin is not null)),
    over or (go = 1 and (n + 1 > 9 or ui + coalesce(tin, 0) > 2500 or uo + coalesce(tout, 0) > 600 or ui + uo + coalesce(tin, 0) + coalesce(tout,
    0) > 2900 or ul + ms > 9000 or uc + cost > 3)), rej + 1 - go, coalesce(reason, '')
  from (select *, case when reason is null then 1 else 0 end as go from (
    select f.example_id, f.lane, c.k, f.n, f.ui, f.uo, f.ul, f.uc, f.unk, f.exact, f.over, f.rej, c.tin, c.tout, c.ms, c.cost, c.rep,
      case when f.unk then 'unknown_usage' when f.n + 1 > 9 then 'calls' when f.over then 'overrun' when f.ui + c.est > 2500 then 'input'
    when 2900 - f.ui - f.uo - c.est <= 0 then 'total'
        when 600 - f.uo <= 0 then 'output' when f.ul >= 9000 then 'latency' when f.uc > 3 then 'cost' when c.most <= 0 then 'output' end as reason
    from f join c on c.example_id = f.example_id and c.lane = f.lane and c.k = f.k + 1) x) y)
"""


@register("ledger_totals", _FOLD + """
select example_id, lane, arg_max(n, k) as attempts, arg_max(ui, k) as used_input, arg_max(uo, k) as used_output, case when arg_max(exact,
    k) then arg_max(ui + uo, k) end as exact_total, arg_max(rej, k) as rejected,
  arg_max(unk, k) as unknown_usage, arg_max(over, k) as overrun, greatest(0, 2900 - arg_max(ui + uo, k))::double as left_total, not arg_max(unk,
    k) and not arg_max(over, k) and arg_max(n, k) < 9 and arg_max(ui + uo, k) < 2900 and arg_max(uo, k) < 600 as may_call
from f group by example_id, lane""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.replay(calls(spark, sf_dir), ["example_id", "lane"], ["ts", "attempt_id"], LIMITS)
    return found.select("example_id", "lane", "attempts", "used_input", "used_output", "exact_total", "rejected", "unknown_usage", (F.size("overrun") > 0).alias("overrun"), "left_total", "may_call")


@register("ledger_rejections", _FOLD + "select why as reason, count(*) as n from f where k > 0 and why <> '' group by why")
def ledger_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.replay(calls(spark, sf_dir), ["example_id", "lane"], ["ts", "attempt_id"], LIMITS)
    return found.select(F.explode("decisions").alias("d")).where("d.rejected is not null").groupBy(F.col("d.rejected").alias("reason")).agg(F.count("*").alias("n"))
