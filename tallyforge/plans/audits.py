"""Audits of attempts, examples and selections, and the projections that reports are made of."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import failures, quality, routing, scoring, store
from tallyforge.plans import bindings as b
from tallyforge.plans.corpus import _EXTRACTION, _QA, _SUMMARY, corpus
from tallyforge.plans.examples import examples
from tallyforge.plans.registry import declare, register
from tallyforge.plans.routers import _SIGNALS, _initial
from tallyforge.plans.scores import _ALL

# Attempts against a frozen recipe: each rule with its condition
_RULES = {
    "UNFINISHED": "outcome = 'STARTED'", "USAGE_NOT_REPORTED": "usage_status <> 'PROVIDER_REPORTED'", "RETRIED": "attempt_index > 0", "TIME_REVERSED": "ended_at < started_at",
    "STOPPED_BY_LENGTH": "finish_reason = 'length'", "PROMPT_NOT_FROZEN": "prompt_version not like 'p1%'", "CRITIC_CONTRACT": "(role = 'critic') <> (prompt_version like '%critic-contract%')",
    "SEED_NOT_EXPECTED": "(attempt_id % 7) <> (seq % 7) and seq > 5", "TOO_MANY_TOKENS": "input_tokens > 900",
}
declare("attempt_policy_audit", "select run_id, code, count(*) as n from (select run_id, explode(array_compact(array(" + ", ".join(f"case when {rule} then '{code}' end" for code, rule in _RULES.items()) + "))) as code from {trials}) x group by run_id, code",
    " union all ".join(f"select run_id, '{code}' as code, count(*) as n from {{trials}} where {rule} group by run_id" for code, rule in _RULES.items()))
declare("attempt_links", """
with d as (select attempt_id, count(*) as n, count(distinct logical_call_id) as links from {trials} group by attempt_id)
select t.run_id as run_id, count(*) as attempts, cast(sum(case when d.n > 1 then 1 else 0 end) as bigint) as repeated_ids,
    cast(sum(case when d.links > 1 then 1 else 0 end) as bigint) as split_links
from {trials} t join d on t.attempt_id = d.attempt_id group by t.run_id""")
declare("experiment_reports", """
select e.experiment_id as experiment_id, e.name as name, e.config_hash as config_hash, count(distinct r.run_id) as runs,
    count(distinct case when r.status = 'COMPLETED' then r.run_id end) as completed,
  count(p.example_id) as predictions, round(avg(p.task_score), 6) as mean_score, round(avg(p.tokens), 6) as mean_tokens
from {experiments} e left join {runs} r on r.experiment_id = e.experiment_id left join {preds} p on p.run_id = r.run_id group by e.experiment_id, e.name, e.config_hash""")
declare("reproduction_plans", """
select experiment_id, name, config_hash, dataset_hash, concat('run --config ', name, '-', cast(config_hash as string), '.json --db out.db') as command from {experiments}""")
# the first hundred are taken by a limit, from every task's own first hundred, and only these are numbered
declare("example_prefix", "select example_id, row_number() over (order by example_id) as place from (select example_id from {dims} order by example_id limit 100) x",
    "select example_id, place from (select example_id, row_number() over (order by example_id) as place from {dims}) x where place <= 100")
declare("first_failing_ids", """
with t as (select run_id, example_id, count(*) as n from {trials} where outcome = 'TIMEOUT' group by run_id, example_id),
few as (select run_id, array_sort(collect_list(example_id)) as first_ids from (
  select run_id, example_id, row_number() over (partition by run_id order by example_id) as place from t) x where place <= 5 group by run_id)
select n.run_id as run_id, n.n as n, few.first_ids as first_ids from (select run_id, sum(n) as n from t group by run_id) n join few on n.run_id = few.run_id""", """
select run_id, count(*) as n, list_sort(list_distinct(list(example_id)))[1:5] as first_ids from {trials} where outcome = 'TIMEOUT' group by run_id""")
declare("set_differences", """
with a as (select distinct example_id from {metrics} where strategy = 1), c as (select distinct example_id from {metrics} where strategy = 2)
select 'missing' as side, example_id from (select example_id from a except select example_id from c) x union all select 'extra', example_id from (select example_id from c except select example_id from a) y""")
declare("dev_and_test", """
select split, count(*) as n, count(distinct family) as families from (select split, family from {dims} where split = 'O' union all select split, family from {dims} where split = 'F') x group by split""")
declare("aligned_calls", """
with x as (select logical_call_id, attempt_id, row_number() over (partition by logical_call_id order by attempt_id, seq, latency_ms) as i from {trials}
    where attempt_index = 0),
y as (select logical_call_id, attempt_id, row_number() over (partition by logical_call_id order by attempt_id, seq, latency_ms) as i from {trials}
    where attempt_index = 1)
select coalesce(x.logical_call_id, y.logical_call_id) as logical_call_id, coalesce(x.i, y.i) as i, x.attempt_id as first_attempt, y.attempt_id as second_attempt from x full outer join y on x.logical_call_id = y.logical_call_id and x.i = y.i""")
declare("pair_diversity", """
with g as (select user_id, day, count(*) as n, count(distinct answer) as answers, max(confidence) - min(confidence) as spread from {candidates}
    group by user_id, day)
select count(*) as pairs, round(avg(cast(case when answers = 1 then 1 else 0 end as double)), 6) as agreement, round(avg(spread), 6) as mean_spread from g where n = 2""")
declare("router_summary", """
with r as (select run_id, example_id, case when max(case when role like 'agent%' then 1 else 0 end) = 1 then 'debate' else 'critic' end as route,
    count(*) as calls, cast(sum(latency_ms) as bigint) as ms from {trials} group by run_id, example_id)
select r.route as route, d.difficulty as difficulty, count(*) as n, round(avg(p.task_score), 6) as mean_score, round(avg(r.calls), 6) as mean_calls,
    round(avg(r.ms), 4) as mean_ms, cast(sum(case when p.task_score < 1 then 1 else 0 end) as bigint) as imperfect
from r join {preds} p on r.run_id = p.run_id and r.example_id = p.example_id join {dims} d on d.example_id = r.example_id join {runs} u on u.run_id = r.run_id group by r.route, d.difficulty""")
declare("selection_audit", """
with few as (select task, difficulty, array_sort(collect_list(example_id)) as first_ids from (
  select task, difficulty, example_id, row_number() over (partition by task, difficulty order by example_id) as place from {dims}) x where place <= 20 group by task, difficulty),
c as (select task, difficulty, count(*) as n, count(distinct family) as families, count(distinct scenario) as scenarios from {dims} group by task, difficulty)
select c.task as task, c.difficulty as difficulty, n, families, scenarios, first_ids from c join few on c.task = few.task and c.difficulty = few.difficulty""", """
select task, difficulty, count(*) as n, count(distinct family) as families, count(distinct scenario) as scenarios, list_sort(list(example_id))[1:20] as first_ids from {dims} group by task, difficulty""")
declare("abstention_pairs", """
select conv_id, turn, u.said as predicted, v.said as should from (select conv_id, turn, length(text) < 40 as said from {conversations} where text is not null) u
join (select conv_id, turn - 1 as turn, length(text) < 60 as said from {conversations} where text is not null) v using (conv_id, turn)""")

_UNION = " union all ".join(f"select * from ({sql}) q{i}" for i, sql in enumerate((_QA, _EXTRACTION, _SUMMARY)))
_CHECKED = ["payload", "evidence", "expected", "support", "chronology", "target", "actions", "facts"]


@register("quality_audit", f"""
with x as (select rule, regexp_extract(issue, '^[^:]+') as bucket, id from ({_UNION}) u where rule not in ('v2_metadata', 'v3_metadata'))
select rule, bucket, count(*) as n, list_sort(list_distinct(list(id)))[1:20] as first_ids from x group by rule, bucket""")
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the whole corpus by rule and kind, with the first twenty ids."""
    found = quality.example_issues(corpus(spark, sf_dir), _CHECKED).withColumn("bucket", F.regexp_extract("issue", "^[^:]+", 0))
    return found.groupBy("rule", "bucket").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, 20).alias("first_ids"))


@register("candidate_scores", f"""
with {_ALL}, j(j) as (values (0), (1), (2))
select k as example_id, j.j as pos, case when k % 4 = 2 then 0.2::double when k % 4 = 1 then case when (k + j.j) % 2 = 0 then 1.0::double
    else 0.6875::double end when k % 7 = 0 then 0.0::double when (k + j.j) % 3 = 0 then 1.0::double else 0.25::double end as task_score
from o join j on true""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = examples(spark, sf_dir).select("example_id", *failures.EXAMPLE, F.posexplode("candidates").alias("pos", "output"))
    return scoring.task_scores(e).select("example_id", "pos", F.round("task_score", 6).alias("task_score"))


@register("failed_annotations", """
with f as (select run_id, example_id, string_agg(attempt_id::varchar, ',' order by attempt_id) as ids from {trials}
    where outcome = 'PARSE_ERROR_AFTER_RESPONSE' group by run_id, example_id)
select run_id, example_id, 'SCHEMA_FAILURE' as failure_type, 'Returned output failed validation; no replay or field repair.' as rationale, '{{"normalized_error":"PARSE_ERROR","attempt_ids":[' || ids || ']}}' as metadata from f""")
def failed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = b.VIEWS["trials"](spark, sf_dir).where("outcome = 'PARSE_ERROR_AFTER_RESPONSE'").groupBy("run_id", "example_id").agg(F.array_sort(F.collect_list("attempt_id")).alias("attempt_ids"))
    return failures.annotate_failed(failed)


@register("failed_predictions", """
select run_id, example_id, list(attempt_id
    order by attempt_id) filter (where outcome = 'PARSE_ERROR_AFTER_RESPONSE') as attempt_ids,
    min(attempt_id) filter (where outcome = 'PARSE_ERROR_AFTER_RESPONSE') as "primary",
  bool_and(usage_status = 'PROVIDER_REPORTED') and count(*) = count(distinct logical_call_id) as valid from {trials} group by run_id, example_id having count(*) filter (where outcome = 'PARSE_ERROR_AFTER_RESPONSE') > 0""")
def failed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.VIEWS["trials"](spark, sf_dir).withColumn("error", F.col("outcome"))
    return store.failed_predictions(t, ["run_id", "example_id"]).drop("errors")


@register("resume_gates", """
with used as (select run_id, bool_or(outcome = 'STARTED') as unfinished, bool_or(usage_status = 'UNKNOWN_NOT_RETURNED') as unknown from {trials}
    group by run_id),
cohort as (select example_id, row_number() over (order by example_id) as place from (select distinct example_id from {preds}) d),
done as (select run_id, example_id, row_number() over (partition by run_id order by example_id) as place from {preds}),
ord as (select d.run_id, bool_and(d.place = c.place) as prefix from done d join cohort c on d.example_id = c.example_id group by d.run_id),
x as (select r.run_id, 'RUN_COMPLETED' as problem from {runs} r where status = 'COMPLETED' union all select r.run_id, 'UNFINISHED_ATTEMPTS' from {runs} r
    join used u on u.run_id = r.run_id where u.unfinished union all
  select r.run_id, 'UNKNOWN_USAGE' from {runs} r join used u on u.run_id = r.run_id where u.unknown union all select r.run_id, 'CHECKPOINTS_OUT_OF_ORDER'
    from {runs} r join ord o on o.run_id = r.run_id where not o.prefix)
select run_id, problem from x""")
def resume_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.VIEWS["preds"](spark, sf_dir).select("run_id", "example_id")
    placed = spark.sql("select run_id, example_id, row_number() over (partition by run_id order by example_id) as place from {p}", p=p)
    # the cohort's order is that of one list of ids
    cohort = spark.sql("select example_id, row_number() over (order by example_id) as place from (select distinct example_id from {p}) d", p=p)
    found = store.resume_gate(b.VIEWS["runs"](spark, sf_dir), b.VIEWS["trials"](spark, sf_dir), placed, cohort)
    return found.select("run_id", F.explode("problems").alias("problem"))


@register("router_training_rows", f"""
with {_SIGNALS} select v.k as example_id, cites::double as citation_count, round(cover, 6) as citation_coverage, conf as initial_confidence,
    issues::double as validator_failures, case when round(score, 9) >= 0.45 then 1 else 0 end as heuristic_escalates, 'train' as split
from v where ('0x' || substr(sha256('{{{{"example_id":"' || v.k || '"}}}}'), 1, 8))::bigint % 10 < 7""")
def router_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the training split (by digest of the id), and what the transparent router would do."""
    digest = F.sha2(F.concat(F.lit('{"example_id":"'), F.col("example_id").cast("string"), F.lit('"}')), 256)
    rows = routing.signals(_initial(spark, sf_dir)).where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10 < 7)
    named = [F.round(F.element_at("features", F.lit(f)), 6).alias(f) for f in ("citation_count", "citation_coverage", "initial_confidence", "validator_failures")]
    return rows.select("example_id", *named, (F.round("uncertainty", 9) >= 0.45).cast("int").alias("heuristic_escalates"), F.lit("train").alias("split"))
